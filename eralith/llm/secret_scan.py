"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every historical version of a path is content-addressed (SHA-256). The ledger is append-only: a commit adds a row for each
blob that it has read, with the version of each rule that has read it and what they found; the newest row of a blob counts.
Blobs that all current rule versions have read are anti-joined away; the others are read by just the rules that have not,
and findings join back to all paths by address. Thousands of copies of one text cost one scan, a commit reads and writes
its new blobs alone, and a new rule version reads each blob for that rule alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eralith.llm._spark import written

#: Rule -> (pattern, group whose length counts, least length), listed in the order of kinds.
RULES = {
    "assign": (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
    "private_key": (r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1),
    "host_token": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    "chat_token": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    "web_token": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
}
#: rule -> version; a rule whose pattern changes gets a new one.
VERSIONS = dict.fromkeys(RULES, 1)
#: Parts that the paths of one blob are joined in, as one blob may stand at a third of all paths.
PARTS = 16
SPANS = "array<struct<start:int,kind:int,name:string,end:int>>"
BASE_KINDS = ("assign", "access", "hex")


def _spans(text: Column, kind: str) -> Column:
    """array<struct<start, kind, name, end>> of one rule's matches, in code points.

    The pieces between matches and the matches themselves alternate, so their lengths add up to the places.
    """
    pattern, group, least = RULES[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    lengths = F.zip_with(F.split(text, pattern, -1), F.zip_with(matches, counted, lambda m, c: F.struct(F.length(m).alias("n"), F.length(c).alias("c"))), lambda p, m: F.struct(F.length(p).alias("gap"), m.n.alias("n"), m.c.alias("c")))
    number = list(RULES).index(kind)
    walked = F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("found")),
        lambda acc, x: F.struct(
            (acc.at + x.gap + F.coalesce(x.n, F.lit(0))).alias("at"),
            F.when(
                x.c >= least,
                F.concat(acc.found, F.array(F.struct((acc.at + x.gap).alias("start"), F.lit(number).alias("kind"), F.lit(kind).alias("name"), (acc.at + x.gap + x.n).alias("end")))),
            ).otherwise(acc.found).alias("found"),
        ),
    )
    # texts without a match, nearly all of them, need no walk
    return F.when(F.regexp_like(text, F.lit(pattern)), walked.found).otherwise(F.array().cast(SPANS))


def addressed(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, blob, content) of every row with an id; a null text is an empty blob."""
    v = versions.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("content"))
    return v.where("doc_id is not null").withColumn("blob", F.unhex(F.sha2("content", 256)))


def newest(ledger: DataFrame) -> DataFrame:
    """(blob, versions, spans): of each blob what its last commit says; a ledger without commits has one row a blob."""
    if "commit" not in ledger.columns:
        return ledger.select("blob", "versions", "spans")
    return ledger.groupBy("blob").agg(F.max_by(F.struct("versions", "spans"), "commit").alias("row")).select("blob", "row.*")


def unread(v: DataFrame, ledger: DataFrame | None = None, rules: dict[str, int] | None = None) -> DataFrame:
    """(blob, versions, spans) of the blobs of v (addressed) that some rule has not read: only those pairs of blob and rule are read."""
    rules = VERSIONS if rules is None else rules
    # one path of each blob brings its content
    blobs = v.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    has = lambda rule: F.coalesce(F.element_at("versions", rule) == rules[rule], F.lit(False))
    if ledger is None:
        blobs = blobs.select("*", F.lit(None).cast("map<string,int>").alias("versions"), F.lit(None).cast(SPANS).alias("earlier"))
    else:
        known = newest(ledger.join(blobs.select("blob"), "blob", "left_semi")).withColumnRenamed("spans", "earlier")
        blobs = blobs.join(known, "blob", "left").where(~reduce(Column.__and__, map(has, rules), F.lit(True)))
    texts = v.join(blobs, ["doc_id", "blob"])
    each = (F.when(has(rule), F.filter("earlier", lambda s, rule=rule: s["name"] == rule)).otherwise(_spans(F.col("content"), rule)) for rule in rules)
    now = F.create_map(*(F.lit(x) for pair in rules.items() for x in pair))
    # rows that repeat bring a blob more than once
    return texts.select("blob", now.alias("versions"), F.array_sort(F.flatten(F.array(*each))).alias("spans")).dropDuplicates(["blob"])


def scanned(v: DataFrame, ledger: DataFrame | None = None, rules: dict[str, int] | None = None) -> DataFrame:
    """The newest rows (blob, versions, spans) of a ledger once the blobs of v (addressed) are read."""
    new = unread(v, ledger, rules)
    return new if ledger is None else newest(ledger).join(new.select("blob"), "blob", "left_anti").unionByName(new)


def findings(v: DataFrame, ledger: DataFrame) -> DataFrame:
    """(doc_id, blob, spans) of every row of v: what the ledger knows of its blob."""
    # whether a blob has spans is asked of whole ledger rows alone: Catalyst may not ask it of every copy, by scanning it
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")
    found = ledger.where(F.size("spans") > 0).select("blob", "spans", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    paths = v.select("doc_id", "blob", part.alias("part"))
    return paths.join(found, ["blob", "part"], "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def secret_scan(
    versions: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None, rules: dict[str, int] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger): findings (doc_id, blob, spans) for every row with an id; the ledger and what is new in it.

    ledger: what an earlier call returned, or None at first. Only the rows of this commit are written; a ledger of the
    caller's own may be kept as a table to which the rows of the greatest commit are appended. rules: the rules in force and their versions, VERSIONS by
    default; a ledger's findings of other rules are dropped once its blob is read again. spans are sorted by start, then
    by rule. A null text is an empty blob, which has no spans. Rows with the same id and text give the same row once
    each; a row without an id is left out.
    """
    v = addressed(versions, id_col, text_col)
    if ledger is not None and "commit" not in ledger.columns:
        ledger = ledger.withColumn("commit", F.lit(0))
    number = 1 if ledger is None else 1 + (ledger.agg(F.max("commit")).first()[0] or 0)
    new = written(unread(v, ledger, rules).withColumn("commit", F.lit(number)))
    if ledger is None:
        return findings(v, new), new
    ledger = ledger.unionByName(new)
    return findings(v, newest(ledger.join(v.select("blob").distinct(), "blob", "left_semi"))), ledger


def span_text(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of each span, comma-joined."""
    use = spans if kinds is None else F.filter(spans, lambda s: s["name"].isin(*kinds))
    return F.array_join(F.transform(use, lambda s: F.concat_ws(":", s["name"], s.start.cast("string"), s.end.cast("string"))), ",")


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Digest of secret_scan over documents as a history of two commits: ids up to the middle, then the others.

    The second commit is scanned against the ledger that the first has left, so texts that both hold are read once.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    middle = docs.agg(F.expr("min(doc_id) div 2 + max(doc_id) div 2")).first()[0] or 0
    earlier, ledger = secret_scan(docs.where(F.col("doc_id") <= middle))
    later, _ = secret_scan(docs.where(F.col("doc_id") > middle), ledger=ledger)
    n = lambda kind: F.size(F.filter("spans", lambda s: s["name"] == kind)).cast("long")
    return earlier.unionByName(later).select(
        "doc_id", *(n(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(span_text(F.col("spans"), BASE_KINDS).cast("binary"), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
    )
