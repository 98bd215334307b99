"""P1-P3 (and the K13 scoring prompt): prompt columns rendered from templates.

A template is split at its {placeholders} once; the prompt is a native
``concat`` of literal pieces and columns, so inserted text is never
re-scanned for placeholders.  The same split renders SQL for the oracles.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PH = re.compile(r"\{(\w+)\}")

# Node labels, properties and relations offered to the query writer,
# and the reply layouts that the parsers downstream depend on.
GRAPH_SCHEMA = """Node labels and properties:
- :File {path: string, name: string}
- :Class {id: string, name: string, lineno: int, end_lineno: int, file_path: string, code_snippet: string}
- :Function {id: string, name: string, lineno: int, end_lineno: int, file_path: string, code_snippet: string}
- :Package {name: string}
Relationships:
- :CONTAINS_FUNCTION (File -> Function)
- :CONTAINS_CLASS (File -> Class)
- :CALLS (Function -> Function)
- :INHERITS (Class -> Class)
- :OVERRIDES (Function -> Function)
- :IMPORTS (File -> Package)"""

ANALYSIS_LAYOUT = """### Analysis Result
**Main Problem:** [the problem]
**Relevant Files:** [files]
**Relevant Classes:** [classes]
**Relevant Functions/Methods:** [functions or methods]
**Keywords/Concepts:** [keywords]
###"""

QUERY_LAYOUT = """vector_query: |
<natural-language search query>

cypher_query: |
<graph query>"""

PATCH_LAYOUT = """### Step 1: Localized Faulty Components
- File: <path>
- Class: <class>
- Function: <function>

### Step 2: Candidate Patch 1 to 5
#### Candidate Patch (Full Function)
# Candidate Patch <n>
# File: <path>

<the whole updated function>

#### Candidate Patch (Unified Diff)
# Candidate Patch <n> (Unified Diff)

--- a/<path>
+++ b/<path>
<hunks>"""

ISSUE_START = "Issue: "
ISSUE_END = "\n\n1. Say what the main problem is."

ANALYSIS_TEMPLATE = """Analyse this software issue so that its cause can be searched for in the code.
Issue: {issue}

1. Say what the main problem is.
2. Name the files, classes and functions or methods involved, as bare identifiers.
3. Give five specific keywords or concepts for the search; avoid generic words.
4. Only consider code of the project itself, not of installed libraries.
5. No explanations or line numbers inside the lists.

Reply in this layout:
""" + ANALYSIS_LAYOUT + "\n"

QUERY_TEMPLATE = """Write two search queries for a code knowledge base from the analysis below.

Graph schema (use nothing else):
""" + GRAPH_SCHEMA + """

Analysis:
{analysis}

1. A natural-language query for semantic search, with the concepts, keywords and function names.
2. A graph query: match the Function or Class nodes named in the analysis with one IN list, then
   OPTIONAL MATCH their containing File, the Class containing the function and the functions it CALLS;
   group by the matched node with COLLECT(DISTINCT ...) per related set and return one list of maps
   {name, files, classes, called}.  No nested aggregates.

Reply in this layout only:
""" + QUERY_LAYOUT + "\n"

PATCH_TEMPLATE = """Fix the issue below.
Issue:
{issue}

Search results (snippets related to the issue):
{hits}

Graph results (symbols and their relations):
{graph}

1. Decide which results are relevant.
2. Locate the files, classes or functions to change (project code only).
3. Propose five alternative minimal, safe, syntactically valid patches, each both as the full
   updated function and as a unified diff that applies with git apply.  No docstrings unless needed,
   and none in the diff.

Reply in this layout, repeating the Step 2 blocks for candidates 1 to 5:
""" + PATCH_LAYOUT + "\n"

SCORE_TEMPLATE = """Rate how well the patch fixes the issue, from 0 (not at all) to 1 (fully), considering
correctness, syntax, side effects and clarity.

Issue:
{issue}

Patch:
{patch}

Reply with one number between 0 and 1 and nothing else.
"""


def _pieces(template: str) -> list[tuple[bool, str]]:
    out, pos = [], 0
    for m in _PH.finditer(template):
        if m.start() > pos:
            out.append((False, template[pos:m.start()]))
        out.append((True, m.group(1)))
        pos = m.end()
    if pos < len(template):
        out.append((False, template[pos:]))
    return out


def render(template: str, **cols: Column) -> Column:
    """Prompt column: literal pieces and the given columns (null inserts as '')."""
    parts = [F.coalesce(cols[v], F.lit("")) if is_ph else F.lit(v) for is_ph, v in _pieces(template)]
    return F.concat(*parts)


def render_sql(template: str, **exprs: str) -> str:
    """The same prompt as a SQL expression, for oracles."""
    out = []
    for is_ph, v in _pieces(template):
        out.append(f"coalesce({exprs[v]}, '')" if is_ph else "'" + v.replace("'", "''") + "'")
    return "(" + " || ".join(out) + ")"
