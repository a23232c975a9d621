"""Secret scans over an incremental ledger of blobs.

Every version of every file is a blob, addressed by the SHA-256 of its text. The ledger is a Parquet table of (blob, rules that
scanned it, findings); a scan reads only blobs with rules that the ledger hasn't, writes what it found, and joins all findings
back to all paths. A rule's name carries its version, so a changed rule scans all blobs once more and old findings stay.

Each blob's text is scanned once, however many paths have it. Rows of the ledger are written as whole files when a scan ends;
a scan that is broken off leaves none, and the next one scans those blobs again.
A null text is the blob of the empty text. Null or repeated paths are kept as they are. An empty table gives no rows.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BitTable, durable

Found = Iterator[tuple[int, int]]

# The patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # all of a run, as it begins at the run's first character
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: The whole key: up to the END line, or, where that is missing, as far as lines of base64 follow.
PEM = re.compile(
    r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"
    r"(?:(?:[^-]|-{1,4}[^-])*-----END (?:[A-Z]+ )*PRIVATE KEY-----|(?:[ \t\r\n]+[A-Za-z0-9+/=]{16,})*)"
)
HUB = re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}")
JWT = re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
SLACK = re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}")
LOGIN = re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\s:/@]+:[^\s:/@]{3,}@[^\s/@]+")


def _assign(text: str) -> Found:
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                yield m.span()


def _access(text: str) -> Found:
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 20:
                yield m.span()


def _pattern(pattern: re.Pattern, needs: str) -> Callable[[str], Found]:
    return lambda text: (m.span() for m in pattern.finditer(text)) if needs in text else iter(())


#: Rules by kind, in the order of the report: version and function. The first three are the base kinds.
RULES: dict[str, tuple[int, Callable[[str], Found]]] = {
    "assign": (1, _assign),
    "access": (1, _access),
    "hex": (1, lambda text: (m.span() for m in HEX.finditer(text))),
    "pem": (2, _pattern(PEM, "PRIVATE KEY-----")),
    "hub": (1, _pattern(HUB, "gh")),
    "jwt": (1, _pattern(JWT, "eyJ")),
    "slack": (1, _pattern(SLACK, "xox")),
    "login": (2, _pattern(LOGIN, "://")),
}
BASE = ("assign", "access", "hex")
LEDGER = "blob binary, rules array<string>, findings array<struct<rule:string,start:int,end:int>>"


def rule_names(rules: dict = RULES) -> list[str]:
    return [f"{kind}@{version}" for kind, (version, _) in rules.items()]


def new_ledger(spark: SparkSession) -> str:
    """A place for a ledger in the folder that all executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="ledger-")
    return f"{shared.rstrip('/')}/ledger-{uuid.uuid4().hex}"


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def blob_of(text) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def unseen(versions: DataFrame, ledger: str, rules: dict = RULES) -> DataFrame:
    """(blob, text, todo) of each blob for which the ledger lacks rules. The ledger is asked with the blobs' addresses alone; only texts
    that have to be scanned are shuffled (a bit table of fixed size may let a few others pass up to the join)."""
    spark = versions.sparkSession
    done = read_ledger(spark, ledger).select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    wanted = F.array(*[F.lit(r) for r in rule_names(rules)])
    texts = versions.select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    if done.isEmpty():
        return texts.dropDuplicates(["blob"]).withColumn("todo", wanted)
    todo = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo")
    asked = durable(texts.select("blob").distinct().join(done, "blob", "left").select("blob", todo).where(F.size("todo") > 0))
    table = spark.sparkContext.broadcast(BitTable.of(asked.select(F.xxhash64("blob").alias("h")), "h"))

    @F.pandas_udf("boolean")
    def may_be(h):
        return h.__class__(table.value.has(h.to_numpy().view(np.uint64)))

    return texts.where(may_be(F.xxhash64("blob"))).join(asked, "blob").dropDuplicates(["blob"])


def scan(versions: DataFrame, ledger: str, rules: dict = RULES) -> None:
    """Scan the blobs of ``versions`` (column text) with the rules that the ledger hasn't for them, and add what is found."""
    by_name = {f"{kind}@{version}": find for kind, (version, find) in rules.items()}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            out = []
            for text, names in zip(batch.column("text"), batch.column("todo").to_pylist(), strict=True):
                text = text.as_py()
                out.append([{"rule": n, "start": a, "end": b} for n in names for a, b in by_name[n](text)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("blob"), batch.column("todo"), pa.array(out, kind)], names=["blob", "rules", "findings"]
            )

    unseen(versions, ledger, rules).mapInArrow(find, LEDGER).write.mode("append").parquet(ledger)


def findings(versions: DataFrame, ledger: str, rules: dict = RULES) -> DataFrame:
    """All columns of ``versions`` but text, with ``found``: what the current rules found in each row's text, by place, then in
    the order of the rules: structs (start, rank, end, kind)."""
    names = rule_names(rules)
    kinds = F.array(*[F.lit(n.partition("@")[0]) for n in names])
    ranked = F.array(*[F.lit(n) for n in names])
    rows = read_ledger(versions.sparkSession, ledger).select("blob", F.explode("findings").alias("f"))
    rank = F.array_position(ranked, F.col("f.rule")).cast("int") - 1
    rows = rows.select("blob", "f.start", rank.alias("rank"), "f.end").where("rank >= 0")
    rows = rows.withColumn("kind", F.get(kinds, F.col("rank")))
    per_blob = rows.groupBy("blob").agg(F.sort_array(F.collect_set(F.struct("start", "rank", "end", "kind"))).alias("found"))
    # An added column must not clash with one of versions, whatever their names: the rows travel as one struct.
    rest = [F.col(f"`{c}`") for c in versions.columns if c != "text"]
    paths = versions.select(F.struct(*rest).alias("path"), blob_of(F.col("text")).alias("blob"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return paths.join(per_blob, "blob", "left").select("path", F.coalesce("found", none).alias("found"))


def secret_digest(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """Counts and places of the secrets of each document, after a scan of what the ledger hasn't (a new one if not given)."""
    ledger = ledger or new_ledger(docs.sparkSession)
    versions = docs.select("doc_id", "text")
    scan(versions, ledger)
    base = F.filter("found", lambda f: f["rank"] < len(BASE))
    count = lambda k: F.size(F.filter("found", lambda f: f["kind"] == k)).cast("long")
    line = lambda a: F.concat_ws(",", F.transform(a, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))))
    return findings(versions, ledger).select(
        "path.doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(line(base), 256).alias("base_sha256"),
        line(F.col("found")).alias("spans"),
    )
