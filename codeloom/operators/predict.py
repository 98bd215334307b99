"""Batch model calls as a plug-in over Arrow batches.

``predict`` adds a reply column by calling a predictor on batches of prompts
inside ``mapInPandas``.  A predictor is a factory ``() -> (list[str] ->
list[str])``; the factory runs once per Python worker (cached), never on the
driver.  Providers are looked up by name when the plan is built, so an
unknown name fails before any task runs.  Model replies are checkpointed so a
downstream fan-out or a retried stage does not call the model again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import cut_lineage

Predictor = Callable[[list[str]], list[str]]
Factory = Callable[[], Predictor]

_TOKEN = r"[^\p{L}\p{N}]+"


def _tokens(text: str) -> list[str]:
    import regex
    return [t for t in regex.split(_TOKEN, text.lower()) if t]


def keyword_stub() -> Predictor:
    """Analysis stand-in: the sorted distinct tokens of the issue (the text between the
    analysis prompt's issue markers; the whole prompt if they are absent) as the keyword line."""
    from .prompts import ISSUE_END, ISSUE_START

    def issue_of(p):
        i = p.find(ISSUE_START)
        j = p.rfind(ISSUE_END)
        return p[i + len(ISSUE_START):j] if 0 <= i < j else p

    def run(prompts):
        return ["### Analysis Result\n**Keywords/Concepts:** " + " ".join(sorted(set(_tokens(issue_of(p)))))
                + "\n###" for p in prompts]
    return run


# Fixed value: the graph query the query stand-in always writes.
STUB_CYPHER = ("MATCH (f:Function) WHERE f.name IN $names\n"
               "OPTIONAL MATCH (file:File)-[:CONTAINS_FUNCTION]->(f)\n"
               "RETURN COLLECT({name: f.name, files: [file.path]}) AS results")


def query_stub() -> Predictor:
    """Query-writer stand-in: the keyword line of the analysis in the prompt as the vector query."""
    marker = "**Keywords/Concepts:** "

    def run(prompts):
        out = []
        for p in prompts:
            i = p.find(marker)
            kw = p[i + len(marker):].split("\n", 1)[0] if i >= 0 else ""
            out.append(f"vector_query: |\n{kw}\n\ncypher_query: |\n{STUB_CYPHER}")
        return out
    return run


def patch_stub() -> Predictor:
    """Patch-writer stand-in: one candidate that re-emits the first hit's function unchanged."""
    def run(prompts):
        out = []
        for p in prompts:
            i = p.find("def ")
            body = p[i:].split("\n\n", 1)[0] if i >= 0 else "def fix():\n    pass"
            out.append("### Step 1: Localized Faulty Components\n- File: unknown.py\n- Function: fix\n\n"
                       "### Step 2: Candidate Patch 1 to 5\n#### Candidate Patch (Full Function)\n"
                       "# Candidate Patch 1\n# File: unknown.py\n\n" + body + "\n\n"
                       "#### Candidate Patch (Unified Diff)\n# Candidate Patch 1 (Unified Diff)\n\n"
                       "--- a/unknown.py\n+++ b/unknown.py\n@@ -1 +1 @@\n-    pass\n+    return None\n")
        return out
    return run


def score_stub() -> Predictor:
    """Scoring stand-in: 1 / (1 + number of lines in the prompt), as text."""
    def run(prompts):
        return [str(round(1.0 / (1 + p.count("\n")), 4)) for p in prompts]
    return run


PROVIDERS: dict[str, Factory] = {
    "stub-keywords": keyword_stub,
    "stub-queries": query_stub,
    "stub-patch": patch_stub,
    "stub-score": score_stub,
}

# Calls a batch of prompts goes to the model with.
BATCH = 32
_MODELS: dict[str, Predictor] = {}
_TOKENS: dict[int, tuple[Factory, str]] = {}


def resolve(provider: str | Factory) -> tuple[str, Factory]:
    """(token, factory): the token is one factory's for the whole application, whatever its name."""
    if not callable(provider) and provider not in PROVIDERS:
        raise ValueError(f"Unsupported model provider: {provider!r}")
    factory = provider if callable(provider) else PROVIDERS[provider]
    if id(factory) not in _TOKENS:
        _TOKENS[id(factory)] = (factory, uuid.uuid4().hex)      # held, so that the id stays its own
    return _TOKENS[id(factory)][1], factory


def worker_model(token: str, factory: Factory) -> Predictor:
    """The model, built once a worker process.  Tasks call this by reference, so its table outlives them."""
    if token not in _MODELS:
        _MODELS[token] = factory()
    return _MODELS[token]


def predict(df: DataFrame, prompt: str, out: str, provider: str | Factory,
            persist: bool = True, batch_size: int = BATCH, error: str | None = None) -> DataFrame:
    """Add ``out`` = the model's stripped reply to ``prompt``.

    A failing call gives its batch null replies (and, in the column named by ``error``, the
    exception's text) and leaves the other batches alone.  Where the rows have that column from an
    earlier step, rows with an error are not sent to the model again and keep it.
    """
    token, factory = resolve(provider)
    carried = error is not None and error in df.columns
    fields = [T.StructField(out, T.StringType(), True)] + ([T.StructField(error, T.StringType(), True)] if error and not carried else [])
    schema = T.StructType(df.schema.fields + fields)

    def run(batches):
        from codeloom.operators.predict import worker_model
        for pdf in batches:
            before = pdf[error].tolist() if carried else [None] * len(pdf)
            sent = [i for i, e in enumerate(before) if e is None or e != e]
            all_prompts = pdf[prompt].fillna("").astype(str).tolist()
            prompts = [all_prompts[i] for i in sent]
            replies, errors = [], []
            for at in range(0, len(prompts), batch_size):
                part = prompts[at:at + batch_size]
                try:
                    got, failed = list(worker_model(token, factory)(part)), None
                    if len(got) != len(part):
                        raise ValueError(f"{len(got)} replies to {len(part)} prompts")
                except Exception as e:  # noqa: BLE001 - a failing call must not end the other issues' work
                    got, failed = [None] * len(part), f"{type(e).__name__}: {e}"
                replies += [r.strip() if r is not None else None for r in got]
                errors += [failed] * len(part)
            told, failed_at = [None] * len(pdf), list(before)
            for i, r, e in zip(sent, replies, errors, strict=True):
                told[i], failed_at[i] = r, e
            pdf[out] = pd.Series(told, index=pdf.index, dtype=object)
            if error:
                pdf[error] = pd.Series(failed_at, index=pdf.index, dtype=object)
            yield pdf[[f.name for f in schema.fields]]

    res = df.mapInPandas(run, schema)
    return cut_lineage(res) if persist else res
