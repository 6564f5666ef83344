"""Secret scan over the whole history of a corpus, with a ledger of scanned blobs.

A blob is a text, addressed by the SHA-256 of its bytes. The ledger holds the findings of
every (blob, rule version) that has been scanned; a further call scans only pairs that are
not in it, each blob once however many paths hold it, and findings are joined back to all
paths. The rule version is a digest of the rules, so changed rules cause a new scan.

Spans are code points, end exclusive, and cover the whole match. Defined cases: null
texts are the empty blob; each row gets a row; an empty history gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakescope.llm.words import pieces
from lakescope.session import cut_lineage

# Kind, pattern, least length, group whose length counts, texts of which one must be in the lower-cased text.
RULES = (
    ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    ("access", r"AKIA[A-Z0-9]+", 18, 0, ("akia",)),
    ("hex", r"[0-9a-f]{16,}", 16, 0, ()),  # a run is never cut, so shorter ones need no look
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*(?:-----END [A-Z ]*PRIVATE KEY-----)?", 28, 0, ("private key-----",)),
    ("git_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}", 40, 0, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    ("chat_token", r"\bxox[abposr]-[A-Za-z0-9-]{20,}", 25, 0, ("xox",)),
    ("web_token", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 36, 0, ("eyj",)),
    ("cloud_key", r"\bAIza[0-9A-Za-z_-]{35}", 39, 0, ("aiza",)),
    ("pay_key", r"\b[sr]k_live_[0-9A-Za-z]{16,}", 24, 0, ("_live_",)),
    ("url_login", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{4,128}@", 12, 0, ("://",)),
)
KINDS = tuple(r[0] for r in RULES)
LEDGER = "blob string, version string, findings array<struct<start: int, rank: int, kind: string, end: int>>"


def rule_version(rules=RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def scan_text(text: str, rules, compiled) -> list[dict]:
    """All findings of one text by start, then by the rules' order."""
    low, out = text.lower(), []
    for rank, ((kind, _, least, group, needs), pattern) in enumerate(zip(rules, compiled, strict=True)):
        if needs and not any(n in low for n in needs):
            continue
        out += [{"start": m.start(), "rank": rank, "kind": kind, "end": m.end()} for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out, key=lambda f: (f["start"], f["rank"]))


def _scan(rules, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r[1]) for r in rules]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
        for batch in batches:
            for piece in pieces(batch, "text"):
                found = [scan_text(t or "", rules, compiled) for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("blob"), pa.array([version] * piece.num_rows, pa.string()), pa.array(found, kind)], names=["blob", "version", "findings"])

    return run


@F.pandas_udf(T.StringType())
def blob_id(text: pd.Series) -> pd.Series:
    return text.map(lambda t: hashlib.sha256((t or "").encode()).hexdigest())


def update_ledger(history: DataFrame, ledger: DataFrame | None = None, path: str = "path", text: str = "text", rules=RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths with their blob, the ledger with all blobs of ``history``, its rows that are new)."""
    version = rule_version(rules)
    named = history.select(F.col(path).alias("path"), F.col(text).alias("text")).withColumn("blob", blob_id("text"))
    paths = cut_lineage(named.select("path", "blob"))
    unseen = paths.groupBy("blob").agg(F.min("path").alias("one"))
    if ledger is not None:
        unseen = unseen.join(ledger.filter(F.col("version") == version).select("blob"), "blob", "left_anti")
    same = (named["blob"] == unseen["blob"]) & named["path"].eqNullSafe(unseen["one"])
    fresh = named.join(unseen, same, "left_semi").select("blob", "text").mapInArrow(_scan(rules, version), LEDGER)
    fresh = cut_lineage(fresh.dropDuplicates(["blob"]))  # rows may repeat a path and its text
    return paths, fresh if ledger is None else ledger.unionByName(fresh), fresh


def findings(history: DataFrame, ledger: DataFrame | None = None, path: str = "path", text: str = "text", rules=RULES) -> DataFrame:
    """One row per row of ``history``: path, blob and its findings under the current rules."""
    paths, known, _ = update_ledger(history, ledger, path, text, rules)
    return paths.join(known.filter(F.col("version") == rule_version(rules)).select("blob", "findings"), "blob")
