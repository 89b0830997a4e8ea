"""Secret scans over a content-addressed ledger of blobs.

Every version of a text is addressed by the SHA-256 of its bytes. The ledger remembers which rules, in which version,
have been run over which blob and what they found, so a scan reads only texts whose (blob, rule, version) is new and
joins the findings back to all paths that hold the blob. DataFrame functions only.

Defined results: a null text is the empty text; null or repeated ids are kept, one result row per input row; further
columns are ignored; an empty table gives no rows. Positions are code points, ends exclusive. Matches are the leftmost
non-overlapping ones of a rule, and a match whose value is too short is dropped without being searched again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoveil.llm import base
from chronoveil.session import scratch_path


@dataclass(frozen=True)
class Rule:
    """``group`` of each match of ``pattern`` has ``least`` characters or more. ``hint`` must hold of a text that has a match."""
    kind: str
    version: int
    pattern: str
    group: int
    least: int
    hints: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    def possible(self, text: Column) -> Column:
        if not self.hints:
            return text.rlike(self.pattern)
        low = F.lower(text)
        out = F.lit(False)
        for hint in self.hints:
            out = out | F.contains(low, F.lit(hint))
        return out


# Fixed patterns of the three kinds. Letters of the keywords are taken in either case.
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"(AKIA[A-Z0-9]+)"
#: A run of at least 24 is the same as a run that is then found to be long enough: runs end only at other characters.
HEX = r"([0-9a-f]{24,})"

BASE_RULES = (
    Rule("assign", 1, ASSIGN, 2, 6, ("password", "passwd", "secret", "token", "api")),
    Rule("access", 1, ACCESS, 1, 20, ("akia",)),
    Rule("hex", 1, HEX, 1, 24),
)


def _exists(spark, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _hits(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Spans of each blob, from (blob, rules, text). Pieces between matches and matches alternate: running lengths are positions."""
    text = F.col("text")
    scans = [F.when(F.array_contains("rules", r.name) & r.possible(text), F.struct(
        F.lit(i).alias("rank"), F.lit(r.kind).alias("kind"), F.lit(r.name).alias("rule"), F.lit(r.least).alias("least"),
        F.arrays_zip(F.split(text, r.pattern, -1).alias("gap"),
                     F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0)).alias("match"),
                     F.regexp_extract_all(text, F.lit(r.pattern), F.lit(r.group)).alias("value")).alias("parts")))
        for i, r in enumerate(rules)]
    each = texts.select("blob", F.explode(F.array_compact(F.array(*scans))).alias("s"))
    rows = each.select("blob", "s.rank", "s.kind", "s.rule", "s.least", F.posexplode("s.parts").alias("at", "part"))
    rows = rows.filter(F.col("part.match").isNotNull()).select(
        "blob", "rank", "kind", "rule", "least", "at", F.length("part.gap").alias("gap"),
        F.length("part.match").alias("width"), F.length("part.value").alias("value"))
    end = F.expr("sum(gap + width) over (partition by blob, rule order by at rows unbounded preceding)").cast("int")
    spans = rows.withColumn("end", end).filter("value >= least").select(
        "blob", F.struct((F.col("end") - F.col("width")).alias("start"), "rank", "end", "kind", "rule").alias("span"))
    return spans.groupBy("blob").agg(F.sort_array(F.collect_list("span")).alias("spans"))


def scan_versions(versions: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = BASE_RULES,
                  doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Bring the ledger up to date with ``versions`` and return (paths, findings).

    ``paths`` has doc_id and blob for every version, ``findings`` one row (blob, spans) for each blob with a finding of
    these rules. ``ledger`` is a folder that may hold earlier scans; without one a new ledger is begun.
    """
    spark = base.set_up(versions.sparkSession)
    docs = base.documents(versions, doc_id, text).select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("blob", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    key = F.coalesce("doc_id", F.lit(-(2 ** 63)))
    known = ledger is not None and _exists(spark, ledger)
    ledger = ledger or scratch_path(spark, "blob-ledger")
    names = F.array(*[F.lit(r.name) for r in rules])
    blobs = docs.groupBy("blob").agg(F.min(key).alias("holder"))
    if known:
        seen = spark.read.parquet(ledger).select("blob", F.explode("rules").alias("rule"))
        todo = (blobs.select("blob", "holder", F.explode(names).alias("rule")).join(seen, ["blob", "rule"], "left_anti")
                .groupBy("blob", "holder").agg(F.collect_set("rule").alias("rules")))
    else:
        todo = blobs.select("blob", "holder", names.alias("rules"))
    todo = base.written(todo, "unseen-blobs")
    # One text for each blob. Copies mostly differ in their id, so a text with many copies is not one join key; repeated rows, and
    # copies without id, become one before the shuffle.
    texts = (docs.withColumn("holder", key).select("blob", "holder", "text").dropDuplicates(["blob", "holder"])
             .join(todo.select("blob", "holder", "rules"), ["blob", "holder"]))
    hits = _hits(texts.select("blob", "rules", "text"), rules)
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string,rule:string>>)")
    done = todo.join(hits, "blob", "left").select("blob", "rules", F.coalesce("spans", none).alias("spans"))
    done.write.mode("append").parquet(ledger)
    base.discard(todo)
    current = {r.name for r in rules}
    found = (spark.read.schema(done.schema).parquet(ledger).filter(F.size("spans") > 0)
             .select("blob", F.filter("spans", lambda s: s.rule.isin(*current)).alias("spans")).filter(F.size("spans") > 0))
    found = found.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    return docs.select("doc_id", "blob"), base.written(found, "blob-findings")


def spans_per_document(versions: DataFrame, **options) -> DataFrame:
    """doc_id, blob and all spans (start, rank, end, kind, rule) of every version, ordered by start, then rule."""
    paths, found = scan_versions(versions, **options)
    return paths.join(found, "blob", "left").select("doc_id", "blob", "spans")


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind, hash of the base spans and all spans as text."""
    spans = F.coalesce("spans", F.array())
    count = lambda kind: F.size(F.filter(spans, lambda s: s.kind == kind)).cast("bigint")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(span_text(F.filter(spans, lambda s: s.rule.isin(*[r.name for r in BASE_RULES]))).cast("binary"), 256)
        .alias("base_sha256"), span_text(spans).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = BASE_RULES, ledger: str | None = None,
           doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping spans as one) and ``n_chars`` counted anew.

    Rows without a finding stay as they are, nulls included. Blobs with findings are joined by address.
    """
    _, found = scan_versions(docs, ledger, rules, doc_id, text)
    blob, spans = base.fresh(docs, "blob"), base.fresh(docs, "spans")
    found = found.select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    keyed = docs.withColumn(blob, F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)))
    joined = keyed.join(found, blob, "left")
    merged = F.aggregate(
        F.col(spans), F.expr("named_struct('at', 0, 'gaps', cast(array() as array<struct<a:int,b:int>>))"),
        lambda acc, s: F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(
            (s["start"] >= acc["at"]) | (F.size(acc["gaps"]) == 0),
            F.array_append(acc["gaps"], F.struct(acc["at"].alias("a"), s["start"].alias("b"))))
            .otherwise(acc["gaps"]).alias("gaps")))
    body = F.col(text)
    new = F.concat(F.array_join(F.transform(merged["gaps"], lambda g: F.concat(
        F.substring(body, g["a"] + 1, g["b"] - g["a"]), F.lit(mark))), ""), F.substring(body, merged["at"] + 1, F.length(body)))
    changed = {text: F.when(F.col(spans).isNull(), body).otherwise(new)}
    out = joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns], spans)
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(F.col(spans).isNull(), F.col(n_chars)).otherwise(
            F.length(text)).cast(docs.schema[n_chars].dataType))
    return out.select(*docs.columns)
