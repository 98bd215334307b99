"""model replies derived from conversations.

One reply per conversation; one candidate per assistant turn (ordered by
turn).  The function text is one of eight templates picked by
(conv_id + turn) % 8; the diff has `turn` added and `conv_id % 40` removed
lines.  Every 10th reply lacks '### Step 2:', every 11th lacks the diff
section, and the model's score reply is (conv_id % 10) / 10, 'n/a' for
every 7th.  The same definitions render the Spark columns and the SQL of the
oracle, so the expected candidates are built by concatenation, not regex.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

# The eight candidate templates ({name} is the function name).
TEMPLATES = (
    "def {name}(x):\n    return x + 1",
    "def {name}(x):\n    try:\n        return int(x)\n    except:\n        return None",
    "def {name}(x):\n    try:\n        return int(x)\n    except Exception:\n        return None",
    'def {name}(x):\n    """Return x."""\n    return x',
    "def {name}(x):\n    a = 1\n    b = 2\n    c = 3\n    d = 4\n    e = 5\n    f = 6\n    return a + b + c + d + e + f + x",
    "def {name}(items):\n    out = []\n    for i in items:\n        try:\n            out.append(int(i))\n        except ValueError:\n            continue\n    return out",
    "def {name}(x)\n    return x",
    "",
)
# Score truth per template: (syntax, exception, docstring, variable, pattern).
TEMPLATE_SCORES = (
    (1.0, 1.0, 1.0, 1.0, 0.5),
    (1.0, 0.3, 1.0, 1.0, 0.5),
    (1.0, 0.6, 1.0, 1.0, 0.5),
    (1.0, 1.0, 0.0, 1.0, 0.5),
    (1.0, 1.0, 1.0, 0.6, 0.5),
    (1.0, 1.0, 1.0, 1.0, 1.0),
    (0.0, 1.0, 1.0, 1.0, 0.5),
    (1.0, 1.0, 1.0, 1.0, 0.5),
)
REMOVED_LINE = "-    pass"
ADDED_LINE = "+    return None"


# ---------------------------------------------------------------- Spark side

def _s(c) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def template_text(t: Column, name: Column) -> Column:
    arr = F.array(*[F.lit(x) for x in TEMPLATES])
    return F.replace(F.element_at(arr, t + 1), F.lit("{name}"), name)


def diff_body(conv: Column, turn: Column) -> Column:
    return F.concat(F.lit("--- a/f_"), _s(conv), F.lit(".py\n+++ b/f_"), _s(conv), F.lit(".py\n@@ -1 +1 @@"),
                    F.repeat(F.lit("\n" + REMOVED_LINE), (conv % 40).cast("int")),
                    F.repeat(F.lit("\n" + ADDED_LINE), turn.cast("int")))


def block(conv: Column, turn: Column, n: Column) -> Column:
    name = F.concat(F.lit("fn_"), _s(conv), F.lit("_"), _s(turn))
    func = template_text(((conv + turn) % 8).cast("int"), name)
    head = F.concat(F.lit("#### Candidate Patch (Full Function)\n# Candidate Patch "), _s(n),
                    F.lit("\n# File: f_"), _s(conv), F.lit(".py\n\n"), func)
    diff = F.concat(F.lit("\n\n#### Candidate Patch (Unified Diff)\n# Candidate Patch "), _s(n),
                    F.lit(" (Unified Diff)\n\n"), diff_body(conv, turn))
    return F.concat(head, F.when(conv % 11 == 0, F.lit("")).otherwise(diff))


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, reply, score_reply, issue): one model reply per conversation."""
    cv = table(spark, sf, "conversations")
    turns = (cv.groupBy("conv_id")
             .agg(F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.col("turn")))).alias("turns"),
                  F.min_by("text", "turn").alias("issue")))
    conv = F.col("conv_id")
    blocks = F.transform(F.col("turns"), lambda t, i: block(conv, t, i + 1))
    step1 = F.concat(F.lit("### Step 1: Localized Faulty Components\n- File: f_"), _s(conv),
                     F.lit(".py\n- Function: fn_"), _s(conv), F.lit("\n\n"))
    step2 = F.when(conv % 10 == 0, F.lit("### Candidates\n")).otherwise(F.lit("### Step 2: Candidate Patch 1 to 5\n"))
    reply = F.concat(step1, step2, F.array_join(blocks, "\n\n"), F.lit("\n"))
    score_reply = F.when(conv % 7 == 0, F.lit("n/a")).otherwise(((conv % 10) / 10.0).cast("string"))
    return turns.select("conv_id", reply.alias("reply"), score_reply.alias("score_reply"), "issue")


# ---------------------------------------------------------------- SQL side

def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_template(t: str, name: str) -> str:
    arr = "[" + ", ".join(_q(x) for x in TEMPLATES) + "]"
    return f"replace({arr}[({t}) + 1], '{{name}}', {name})"


def sql_template_scores(t: str, i: int) -> str:
    return "[" + ", ".join(repr(s[i]) for s in TEMPLATE_SCORES) + f"][({t}) + 1]"


def _v(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def sql_diff_body(conv: str, turn: str) -> str:
    return (f"'--- a/f_' || {_v(conv)} || '.py\n+++ b/f_' || {_v(conv)} || '.py\n@@ -1 +1 @@' || "
            f"repeat({_q(chr(10) + REMOVED_LINE)}, CAST({conv} % 40 AS INTEGER)) || "
            f"repeat({_q(chr(10) + ADDED_LINE)}, CAST({turn} AS INTEGER))")


def sql_func(conv: str, turn: str) -> str:
    name = f"'fn_' || {_v(conv)} || '_' || {_v(turn)}"
    return sql_template(f"CAST(({conv} + {turn}) % 8 AS INTEGER)", name)


def sql_block(conv: str, turn: str, n: str) -> str:
    return (f"'#### Candidate Patch (Full Function)\n# Candidate Patch ' || {_v(n)} || '\n# File: f_' || {_v(conv)} "
            f"|| '.py\n\n' || {sql_func(conv, turn)} || CASE WHEN {conv} % 11 = 0 THEN '' ELSE "
            f"'\n\n#### Candidate Patch (Unified Diff)\n# Candidate Patch ' || {_v(n)} || ' (Unified Diff)\n\n' || "
            f"{sql_diff_body(conv, turn)} END")


# Assistant turns with their ordinal n, one row per candidate.
SQL_TURNS = """
aturn AS (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS n
       FROM conversations WHERE role = 'assistant')
"""


def sql_replies() -> str:
    """CTE body 'rep(conv_id, reply)' rendering the same replies in SQL."""
    return f"""
{SQL_TURNS},
blk AS (SELECT conv_id, string_agg({sql_block('conv_id', 'turn', 'n')}, '\n\n' ORDER BY turn) AS blocks
        FROM aturn GROUP BY conv_id),
rep AS (SELECT c.conv_id,
               '### Step 1: Localized Faulty Components\n- File: f_' || CAST(c.conv_id AS VARCHAR) || '.py\n- Function: fn_' || CAST(c.conv_id AS VARCHAR)
               || '\n\n' || CASE WHEN c.conv_id % 10 = 0 THEN '### Candidates\n' ELSE '### Step 2: Candidate Patch 1 to 5\n' END
               || coalesce(b.blocks, '') || '\n' AS reply
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN blk b USING (conv_id))
"""
