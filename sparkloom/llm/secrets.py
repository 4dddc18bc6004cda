"""Secret scans by an incremental ledger of blobs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, join_counted, key_filter, may_be_in

Span = tuple[int, int]


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A change of find needs a new version: the ledger then scans every blob for it again."""

    kind: str
    version: int
    find: Callable[[str], list[Span]]


# The patterns of the three base kinds, and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are whole, so this finds what [0-9a-f]+ of 32 or more does
# What the method adds: private keys, JSON web tokens, prefixed access tokens.
PEM = re.compile(r"-----BEGIN ([A-Z ]{0,40}PRIVATE KEY)-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")
PREFIXED = re.compile(r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{20,})")
#: Every match of ASSIGN holds one of these.
KEYWORDS = ("passw", "secret", "token", "api")


def _assign(text: str) -> list[Span]:
    lower = text.lower()
    if not any(k in lower for k in KEYWORDS):
        return []
    return [m.span() for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]


def _pem(text: str) -> list[Span]:
    """Keys from BEGIN to the END of the same label, whatever headers, escapes or quotes are between.

    Where another BEGIN or nothing comes first, the span is the run of key characters, as PEM has it.
    """
    out, at = [], 0
    while m := PEM.search(text, at):
        after = m.end(1) + len("-----")
        begin = text.find("-----BEGIN ", after)
        mark = f"-----END {m[1]}-----"
        end = text.find(mark, after, begin if begin >= 0 else len(text))
        at = max(m.end(), end + len(mark) if end >= 0 else 0)
        out.append((m.start(), at))
    return out


def _plain(pattern: re.Pattern, least: int = 1) -> Callable[[str], list[Span]]:
    return lambda text: [m.span() for m in pattern.finditer(text) if m.end() - m.start() >= least]


#: In the order in which spans that start together are listed.
RULES = (
    Rule("assign", 1, _assign),
    Rule("access", 1, _plain(ACCESS, 16)),
    Rule("hex", 1, _plain(HEX, 32)),
    Rule("pem", 2, _pem),
    Rule("jwt", 1, _plain(JWT)),
    Rule("prefixed", 1, _plain(PREFIXED)),
)
BASE = ("assign", "access", "hex")
LEDGER = "blob binary, kind string, version int, spans array<struct<start:int,end:int>>"


def blob_of(text: Column) -> Column:
    """Content address: SHA-256 of the UTF-8 text; a null text is an empty one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def extend_ledger(versions: DataFrame, path: str, rules: Sequence[Rule] = RULES) -> None:
    """Scan the blobs of versions (any rows with text) for the rules that the ledger at path lacks, and append.

    A pair of blob and rule version is scanned once, however many rows, now or later, have that
    blob; blobs without findings are entered too. A run that is repeated after a failure may
    enter a pair twice, with the same spans; readers take one. The digests alone are counted and looked up; a text that is new and that
    one row has is scanned where it lies, so that only texts of several rows or for new rules are shuffled.
    """
    names = [f"{r.kind}@{r.version}" for r in rules]
    seen = read_ledger(versions.sparkSession, path).select("blob", F.concat_ws("@", "kind", "version").alias("pair"))
    seen = seen.filter(F.col("pair").isin(names)).groupBy("blob").agg(F.collect_set("pair").alias("seen"))
    rows = versions.select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    every = F.array(*map(F.lit, names))
    missing = F.when(F.col("seen").isNull(), every).otherwise(F.array_except(every, F.col("seen")))
    state = cut(rows.groupBy("blob").agg(F.count("*").alias("copies")).join(seen, "blob", "left").select("blob", missing.alias("missing"), (F.col("seen").isNotNull() | (F.col("copies") > 1)).alias("known")))
    known = key_filter(state.filter("known").select("blob"))
    wanted = cut(state.filter(may_be_in(known, "blob")).filter(F.size("missing") > 0).select("blob", "missing"))
    some = rows.filter(may_be_in(key_filter(wanted.select("blob")), "blob")).dropDuplicates(["blob"]).join(wanted, "blob")
    by_name = dict(zip(names, rules, strict=True))

    def fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(~known(batch.column(0).to_pylist())))
            yield from scan(iter([batch.append_column("missing", pa.array([names] * batch.num_rows, pa.list_(pa.string())))]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            out: list[tuple] = []
            for blob, text, missing in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("blob", "text", "missing")), strict=True):
                blob, text = blob.as_py(), text.as_py()
                for name in missing.as_py():
                    rule = by_name[name]
                    out.append((blob, rule.kind, rule.version, [{"start": a, "end": b} for a, b in rule.find(text)]))
            kinds = (pa.binary(), pa.string(), pa.int32(), spans_type)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["blob", "kind", "version", "spans"])

    found = rows.mapInArrow(fresh, LEDGER).unionByName(some.select("blob", "text", "missing").mapInArrow(scan, LEDGER))
    found.write.mode("append").parquet(path)


def findings(docs: DataFrame, path: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """docs with secrets, an array of (start, place, end, kind) in order, from the ledger's rows for these rules.

    Offsets are code points, the end exclusive; place is the kind's number in rules. Every row, whatever its path or id,
    gets the findings of its blob, and an empty array where there are none.
    """
    current = F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules])
    found = read_ledger(docs.sparkSession, path).filter(F.size("spans") > 0)
    place = F.array_position(current, F.concat_ws("@", "kind", "version")).cast("int")
    found = found.withColumn("place", place).filter("place > 0").dropDuplicates(["blob", "place"])
    each = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("place").alias("place"), s["end"].alias("end"), F.col("kind").alias("kind")))
    found = found.groupBy(F.col("blob").alias("_blob")).agg(F.sort_array(F.flatten(F.collect_list(each))).alias("secrets"))
    found = cut(found)
    docs = docs.drop("secrets").withColumn("_blob", blob_of(F.col("text")))
    none = F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")
    listed = may_be_in(key_filter(found.select("_blob")), "_blob")
    rest = docs.filter(~listed).select(*docs.columns, none.alias("secrets"))
    some = docs.filter(listed)
    # Blobs without findings that seem to be listed are counted too: such a one may be frequent.
    copies = cut(some.groupBy("_blob").agg(F.count("*").alias("_copies")).join(found, "_blob", "left"))
    total = copies.agg(F.coalesce(F.sum("_copies"), F.lit(0))).first()[0]
    joined = join_counted(some, copies, "_blob", "_copies", total).select(*docs.columns, F.coalesce("secrets", none).alias("secrets"))
    return joined.unionByName(rest).drop("_blob")


def scan_secrets(docs: DataFrame, path: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """docs with secrets: the ledger at path is brought up to date, and its findings are joined to all rows.

    A null text is an empty one and has none; repeated rows share a blob; texts are scanned whole;
    an empty table gives an empty result; an input column named secrets is replaced.
    """
    extend_ledger(docs, path, rules)
    return findings(docs, path, rules)


def as_string(secrets: Column) -> Column:
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: str, secrets: Column | str) -> Column:
    """The text column with each run of overlapping spans replaced by one mark; a null text stays null."""
    none = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(so_far: Column, span: Column) -> Column:
        between = F.substring(F.col(text), so_far["at"] + 1, span["start"] - so_far["at"])
        out = F.when(span["start"] >= so_far["at"], F.concat(so_far["out"], between, F.lit("[SECRET]"))).otherwise(so_far["out"])
        return F.struct(out.alias("out"), F.greatest(so_far["at"], span["end"]).alias("at"))

    rest = F.length(text) + 1
    return F.aggregate(secrets, none, step, lambda s: F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, rest)))
