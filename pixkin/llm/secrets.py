"""Secret scans over an incremental ledger of blobs.

Every version of a document is addressed by the SHA-256 of its text.  The ledger holds which blob
was scanned with which version of the rules, and what was found.  An update scans only unseen pairs
of blob and rule version, once a blob however many paths hold it, and findings are joined back to
all paths.  What is new is decided on digests alone.  New texts that one path holds are scanned where they
are read; only new ones of several paths are shuffled, and so are only paths whose blob has findings.
Texts seen before aren't moved, but for the few that bitmaps of the digests can't tell from new ones (from
about 100 million digests on these get many).  Only DataFrame functions are used.

Defined results: a null text counts as empty and has no findings; a null path is reported like any
other; repeated rows are reported once each; an empty table gives no rows; very long texts are scanned
whole; other columns are ignored by `reports`, and kept as they are, whatever their names, by
`without_secrets`.  Spans count code points and exclude their end.  A private key's
span is the whole key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import free_name, maybe_among, shared_dir, written

#: A PEM key up to its END line; where that is missing, up to the last of the base64 lines that follow
#: (plain, quoted, commented or with escaped line breaks) and a shorter one after them.
_SPACE = r"""(?:[\s>#*"',]|\\[nr])*+"""
PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:(?:{_SPACE}(?:[A-Za-z0-9+/]{{16,}}+={{0,2}}|(?:Proc-Type|DEK-Info):[^\n]*+))++"
    rf"""(?:{_SPACE}[A-Za-z0-9+/]{{1,15}}+={{0,2}}(?=[ \t\r]*(?:\n|\z|\\|["'])))?+)?+)"""
)
#: kind: (pattern, group that must be long enough, its least length), matched leftmost without
#: overlap; the first three are the base kinds.
RULES = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "private_key": (PRIVATE_KEY, 0, 1),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
}
BASE_KINDS = 3
KINDS = list(RULES)
SCANNED = "sha256 string, rules string"
FOUND = "sha256 string, rules string, kind int, start long, end long"


def digest(text: str = "text") -> Column:
    return F.sha2(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), 256)


def _hit(kind: int, least: int) -> Callable[[Column, Column], Column]:
    def hit(x: Column, i: Column) -> Column:
        lengths = (F.length(x["gap"]).cast("long").alias("gap"), F.length(x["match"]).cast("long").alias("long"))
        return F.struct(F.lit(kind).alias("kind"), i.alias("at"), *lengths, (F.length(x["value"]) >= least).alias("good"))

    return hit


def scan(blobs: DataFrame, rules: dict = RULES) -> DataFrame:
    """blobs: (sha256, text).  Per finding: sha256, kind (its number among the rules), start, end.

    A text's matches and what lies between them come as two arrays; running sums of their lengths
    are the positions."""
    text, found = F.col("text"), []
    for kind, (pattern, group, least) in enumerate(rules.values()):
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        parts = F.arrays_zip(F.split(text, pattern).alias("gap"), whole.alias("match"), value.alias("value"))
        rows = F.transform(F.filter(parts, lambda x: x["match"].isNotNull()), _hit(kind, least))
        found.append(F.when(text.rlike(pattern), rows))
    hits = F.filter(F.array(*found), lambda x: x.isNotNull())
    hits = blobs.select("sha256", F.explode(hits).alias("hits")).select("sha256", F.inline("hits"))
    up_to = Window.partitionBy("sha256", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("long")).over(up_to)
    return hits.withColumn("end", end).filter("good").select("sha256", "kind", (F.col("end") - F.col("long")).alias("start"), "end")


class BlobLedger:
    """What was scanned and found so far, as two tables under a path that all executors see."""

    def __init__(self, spark: SparkSession, path: str, rules: dict = RULES, version: str = "2"):
        self.spark, self.path, self.rules, self.version = spark, path, rules, version

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self._table("scanned", SCANNED).filter(F.col("rules") == self.version)

    def findings(self) -> DataFrame:
        """Findings under the current rules; an update that was broken off may have left some twice."""
        return self._table("found", FOUND).filter(F.col("rules") == self.version).drop("rules").distinct()

    def update(self, versions: DataFrame) -> None:
        """versions: text, any other columns.  Scans the blobs that these rules haven't seen."""
        blobs, seen = versions.select(digest().alias("sha256"), "text"), self.scanned().select("sha256")
        counts = blobs.groupBy("sha256").agg(F.count("*").alias("paths"))
        new = written(counts.join(seen, "sha256", "left_anti"), "new-blobs")
        known = new.filter("paths > 1").select("sha256").unionByName(seen)
        marked = maybe_among(blobs.filter("text <> ''"), F.col("sha256"), known, "known")
        # first() of equal texts; a text that is copied a lot is summed up in each task first
        several = maybe_among(marked.filter("known"), F.col("sha256"), new.select("sha256"), "new").filter("new")
        several = several.groupBy("sha256").agg(F.first("text").alias("text")).join(new, "sha256", "left_semi")
        mark = F.lit(self.version).alias("rules")
        hits = scan(marked.filter("NOT known").drop("known").unionByName(several), self.rules)
        hits.select("sha256", mark, "kind", "start", "end").write.mode("append").parquet(f"{self.path}/found")
        new.select("sha256", mark).write.mode("append").parquet(f"{self.path}/scanned")


def span_text(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of structs (start, kind, end), comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def reports(versions: DataFrame, ledger: BlobLedger, path: str = "doc_id") -> DataFrame:
    """Per path: the number of findings of each base kind, the base spans' digest and all spans."""
    span = F.struct("start", "kind", "end")
    by_blob = ledger.findings().groupBy("sha256").agg(
        *[F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, k in enumerate(KINDS[:BASE_KINDS])],
        F.array_sort(F.collect_list(span)).alias("found"),
    )
    by_blob = by_blob.withColumn("base", F.filter("found", lambda x: x["kind"] < BASE_KINDS))
    by_blob = by_blob.select("sha256", *[f"n_{k}" for k in KINDS[:BASE_KINDS]], F.sha2(span_text(F.col("base"), KINDS), 256).alias("base_sha256"), span_text(F.col("found"), KINDS).alias("spans"))
    # written, so that Spark splits a blob that very many paths hold
    by_blob = written(by_blob.withColumnsRenamed({"sha256": "blob"}), "findings-by-blob")
    rows = maybe_among(versions.select(F.col(path).alias("path"), digest().alias("sha256")), F.col("sha256"), by_blob.select("blob"), "some")
    none = [F.lit(None).cast(by_blob.schema[c].dataType).alias(c) for c in by_blob.columns]
    out = rows.filter("some").join(by_blob, F.col("sha256") == F.col("blob"), "left").unionByName(rows.filter("NOT some").select("*", *none))
    return out.select(
        F.col("path").alias(path),
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS[:BASE_KINDS]],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def new_ledger(spark: SparkSession) -> BlobLedger:
    return BlobLedger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ledger = new_ledger(spark)
    ledger.update(docs)
    return reports(docs, ledger)


def without_secrets(docs: DataFrame, ledger: BlobLedger) -> DataFrame:
    """The documents, each span found in them replaced by [kind]; overlapping spans become one under the
    first one's kind.  Texts without findings stay as they are, and aren't shuffled."""
    by_start = Window.partitionBy("sha256").orderBy("start", "end", "kind")
    before = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    runs = ledger.findings().withColumn("new", (before.isNull() | (F.col("start") >= before)).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = runs.groupBy("sha256", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max(F.when(F.col("new") == 1, F.col("kind"))).alias("kind"))
    by_blob = runs.groupBy("sha256").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("found"))
    key, hit, blob, found = (free_name(x, docs) for x in ("sha256", "some", "blob", "found"))
    by_blob = written(by_blob.withColumnsRenamed({"sha256": blob, "found": found}), "runs-by-blob")
    rows = maybe_among(docs.withColumn(key, digest()), F.col(key), by_blob.select(blob), hit)
    names, text = F.array(*[F.lit(f"[{k}]") for k in KINDS]), F.col("text")

    def piece(x: Column, i: Column) -> Column:  # what lies between a run and the one before, and its mark
        at = F.coalesce(F.get(F.col(found), i - 1)["end"], F.lit(0))
        return F.concat(F.substring(text, (at + 1).cast("int"), (x["start"] - at).cast("int")), F.get(names, x["kind"]))

    rest = F.substring(text, (F.element_at(F.col(found), -1)["end"] + 1).cast("int"), F.length(text))
    clean = F.when(F.col(found).isNull(), text).otherwise(F.concat(F.array_join(F.transform(found, piece), ""), rest))
    some = rows.filter(F.col(hit)).join(by_blob, F.col(key) == F.col(blob), "left").withColumn("text", clean)
    return some.select(*docs.columns).unionByName(rows.filter(~F.col(hit)).select(*docs.columns))


OP3_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
k AS (SELECT * FROM (VALUES
  (0, 'assign', '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 6),
  (1, 'access', '(AKIA[A-Z0-9]+)', 20), (2, 'hex', '([0-9a-f]{24,})', 24),
  (3, 'private_key', '@KEY@', 1), (4, 'github', '(gh[pousr]_[A-Za-z0-9]{36,})', 40),
  (5, 'slack', '(xox[abprs]-[A-Za-z0-9-]{10,})', 15)) AS k(kind, name, pattern, least)),
m AS (
  SELECT r, 0 AS kind, unnest(regexp_extract_all(text, p0)) AS hit, unnest(regexp_extract_all(text, p0, 1)) AS val, unnest(string_split_regex(text, p0)) AS gap, generate_subscripts(string_split_regex(text, p0), 1) AS i FROM t, (SELECT pattern AS p0 FROM k WHERE kind = 0) WHERE regexp_matches(text, p0)
@MORE@),
s AS (SELECT r, m.kind, name, least, hit, val, sum(length(gap) + length(hit)) OVER (PARTITION BY r, m.kind ORDER BY i) AS stop FROM m JOIN k USING (kind) WHERE hit IS NOT NULL),
f AS (SELECT r, kind, stop - length(hit) AS start, name || ':' || (stop - length(hit))::BIGINT || ':' || (CASE WHEN kind = 3 THEN stop - length(hit) + length(val) ELSE stop END)::BIGINT AS span FROM s WHERE length(val) >= least),
g AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
   sha256(coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256, string_agg(span, ',' ORDER BY start, kind) AS spans FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (r)
"""


def _sql_of_kind(kind: int) -> str:
    """The matches of a kind, made from those of the first.  A private key is one of four groups."""
    out = OP3_SQL.split("m AS (\n")[1].split("\n@MORE@")[0].replace("SELECT r, 0 AS", f"  UNION ALL SELECT r, {kind} AS").replace("kind = 0)", f"kind = {kind})")
    one = "unnest(regexp_extract_all(text, p0, 1)) AS val"
    groups = ", ".join(f"regexp_extract_all(text, p0, {i})" for i in range(1, 5))
    return out.replace(one, f"unnest(list_transform(list_zip({groups}), lambda g: concat(g[1], g[2], g[3], g[4]))) AS val" if kind == 3 else one)


#: The same keys for engines without possessive repeats and lookahead: what follows a last short line is matched
#: outside the group.
_HEAD, _B, _GAP = r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "[A-Za-z0-9+/]", r"""(?:[\x09-\x0d >#*"'',]|\\[nr])*"""
_LONG = rf"(?:{_GAP}(?:{_B}{{16,}}={{0,2}}|(?:Proc-Type|DEK-Info):[^\n]*))+"
_KEY = rf"""({_HEAD}[^-]*(?:-{{1,4}}[^-]+)*-----END [A-Z ]*PRIVATE KEY-----)|({_HEAD}{_LONG}{_GAP}{_B}{{1,15}}={{0,2}})[ \t\r]*(?:\n|\z|\\|["''])|({_HEAD}{_LONG})|({_HEAD})"""
OP3_SQL = OP3_SQL.replace("@MORE@", "\n".join(_sql_of_kind(i) for i in range(1, len(RULES)))).replace("@KEY@", _KEY)
