"""Secret scans through an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its text. The ledger, a Parquet table in
the shared folder, holds the (blob, rule, rule version) triples that were scanned so far and what
they gave; a scan reads only blobs that miss a triple, appends theirs, and joins the findings back
to all paths and versions. Column expressions only.

Defined results: a null text is the empty text; rows with equal text share one scan; two rows with
the same path and version are both kept; an empty table gives no rows; columns of the input whose
names clash with those of the result are kept under a name with a leading underscore.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm.text import text_of

@dataclass(frozen=True)
class Rule:
    """A kind of secret: `pattern`, and how many characters group `group` must have.

    Matches are leftmost and do not overlap; a match whose group is too short is dropped, and what
    it covered is not looked at again.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1


NAME = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
BASE_RULES = (
    Rule("assign", NAME + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    # Runs of hexadecimal digits that are too short never hide a longer one.
    Rule("hex", "[0-9a-f]{32,}", 0, 32),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z]+://[A-Za-z0-9._-]+:[^\x20\x09-\x0D/@:]+@"),
)
RULES = BASE_RULES + MORE_RULES
SPAN = "struct<rule: string, kind: string, start: bigint, end: bigint>"
LEDGER = f"blob string, rules array<string>, spans array<{SPAN}>"


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def label(rule: Rule) -> str:
    return f"{rule.kind}:{rule.version}"


def spans_of(text: Column, rule: Rule) -> Column:
    """Spans of one rule as an array of (rule, kind, start, end), in code points, end exclusive.

    Built-in functions give the matches and the text between them, but no positions; those follow by
    adding up lengths.
    """
    lengths = lambda pieces: F.transform(pieces, lambda piece: F.length(piece))
    every = lambda group: lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group)))
    steps = F.arrays_zip(
        lengths(F.split(text, rule.pattern, -1)).alias("gap"),
        every(0).alias("size"),
        every(rule.group).alias("held"),
    )

    def step(state: Column, piece: Column) -> Column:
        start = state["at"] + piece["gap"].cast("bigint")
        end = start + F.coalesce(piece["size"], F.lit(0)).cast("bigint")
        names = F.lit(label(rule)).alias("rule"), F.lit(rule.kind).alias("kind")
        span = F.struct(*names, start.alias("start"), end.alias("end")).cast(SPAN)
        kept = F.when(piece["held"] >= rule.least, F.array(span)).otherwise(no_spans())
        return F.struct(end.alias("at"), F.concat(state["spans"], kept).alias("spans"))

    begin = F.struct(F.lit(0).cast("bigint").alias("at"), no_spans().alias("spans"))
    whole = F.aggregate(steps, begin, step, lambda state: state["spans"])
    return F.when(F.regexp(text, F.lit(rule.pattern)), whole).otherwise(no_spans())


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger below `path`, empty if nothing was written yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], LEDGER)


def unseen_blobs(blobs: DataFrame, ledger: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """`blobs` (blob, row) that miss a rule in its present version, with the missing ones as `todo`."""
    done = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob")
    done = done.agg(F.collect_set("rule").alias("done"))
    names = F.array(*[F.lit(label(rule)) for rule in rules])
    todo = F.array_except(names, F.coalesce("done", F.array().cast("array<string>")))
    return blobs.join(done, "blob", "left").select("blob", "row", todo.alias("todo")).where(F.size("todo") > 0)


def scan_versions(
    versions: DataFrame,
    ledger_path: str,
    rules: Sequence[Rule] = RULES,
    path: str = "path",
    version: str | None = None,
    text: str = "text",
) -> DataFrame:
    """Every row of `versions` with its `blob` and the sorted `spans` of all rules.

    First the ledger gets one row for each blob that it misses or that misses a rule; only those are
    scanned. `spans` is an array of (start, place of the rule, kind, end), in this order.
    """
    spark = versions.sparkSession
    rows = versions.withColumnsRenamed({c: "_" + c for c in versions.columns if c in ("blob", "spans")})
    names = [n for n in (path, version) if n]
    content = text_of(text)
    rows = rows.withColumn("blob", F.sha2(content, 256))
    texts = rows.select("blob", F.xxhash64("blob", *names).alias("row"), content.alias("content"))
    firsts = texts.groupBy("blob").agg(F.min("row").alias("row"))
    todo = unseen_blobs(firsts, read_ledger(spark, ledger_path), rules)
    found = F.concat(
        *[
            F.when(F.array_contains("todo", label(rule)), spans_of(F.col("content"), rule)).otherwise(no_spans())
            for rule in rules
        ]
    )
    scanned = texts.join(todo, ["blob", "row"]).select("blob", F.col("todo").alias("rules"), found.alias("spans"))
    scanned.dropDuplicates(["blob"]).write.mode("append").parquet(ledger_path)
    return rows.join(findings(read_ledger(spark, ledger_path), rules), "blob", "left").withColumn(
        "spans", F.coalesce("spans", F.array().cast(SORTED))
    )


SORTED = "array<struct<start: bigint, place: int, kind: string, end: bigint>>"


def findings(ledger: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Per blob with any: the spans of the given rule versions, sorted by start and place of the rule."""
    place = F.create_map(*[F.lit(x) for i, rule in enumerate(rules) for x in (label(rule), i)])
    span = F.explode("spans").alias("span")
    each = ledger.where(F.size("spans") > 0).select("blob", span)
    each = each.where(F.col("span.rule").isin([label(rule) for rule in rules])).distinct()
    item = F.struct(
        F.col("span.start").alias("start"),
        place[F.col("span.rule")].alias("place"),
        F.col("span.kind").alias("kind"),
        F.col("span.end").alias("end"),
    )
    return each.groupBy("blob").agg(F.sort_array(F.collect_list(item)).cast(SORTED).alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def only(spans: Column, rules: Sequence[Rule]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin([rule.kind for rule in rules]))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """`text` with every span replaced by `mark`; overlapping spans give one mark."""
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, span: Column) -> Column:
        gap = F.substring(text, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        parts = F.when(span["start"] >= state["at"], F.concat(state["parts"], F.array(gap, F.lit(mark))))
        end = F.greatest(state["at"], span["end"])
        return F.struct(end.alias("at"), F.coalesce(parts, state["parts"]).alias("parts"))

    def finish(state: Column) -> Column:
        rest = F.substring(text, (state["at"] + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(state["parts"], ""), rest)

    return F.when(F.size(spans) > 0, F.aggregate(spans, state, step, finish)).otherwise(text)
