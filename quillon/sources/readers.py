"""Sources of observation drafts: JSON directories, CSV, RSS and Atom files, inline rows and bulk posts.

All give the same columns, so batches from several sources are one union.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.numbers import lenient_timestamp
from quillon.functions.text import listed

_TEXT = ("provider_record_id", "mode", "content_type", "subject_hint", "occurred_at", "observed_at", "source_url", "raw_text", "raw_json", "previous_snapshot")
DRAFT = T.StructType([T.StructField(n, T.TimestampType() if n.endswith("_at") else T.StringType()) for n in _TEXT])


def _draft(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    given = {n: columns.get(n, F.lit(None)) for n in _TEXT}
    made = [(lenient_timestamp(c.cast("string")) if n.endswith("_at") else c.cast("string")).alias(n) for n, c in given.items()]
    return df.select(*made)


def visible(df: DataFrame, as_of: Column, mode: str | None = None) -> DataFrame:
    """Drafts observed by ``as_of`` (those without a date stay), of one mode if given."""
    seen = df.filter(F.col("observed_at").isNull() | (F.col("observed_at") <= as_of))
    return seen if mode is None else seen.filter(F.coalesce("mode", F.lit("update")) == mode)


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A directory of JSON files, each a list of records or an object with the list under ``observations``.

    A file is one task's work; large ones should hold a record per line and be read with ``lines``, which splits them.

    Nested raw_json and previous_snapshot stay JSON text. Unreadable files give no rows.
    """
    if lines:
        rows = spark.read.text(path, pathGlobFilter="*.json*").select(F.try_parse_json("value").alias("r")).filter("r is not null")
    else:
        whole = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.try_parse_json("value").alias("v"))
        wrapped = F.try_variant_get("v", "$.observations", "array<variant>")
        rows = whole.select(F.explode(F.coalesce(wrapped, F.try_variant_get("v", "$", "array<variant>"))).alias("r"))
    text = lambda n: F.try_variant_get("r", f"$.{n}", "string")
    nested = lambda n: F.to_json(F.try_variant_get("r", f"$.{n}", "variant"))
    return _draft(rows, {n: nested(n) if n in ("raw_json", "previous_snapshot") else text(n) for n in _TEXT})


def read_csv(spark: SparkSession, path: str, cutoff: Column) -> DataFrame:
    """CSV files with a header: every row is a ``csv_row``; blank cells are left out of its JSON.

    The id is record_id, else file and row, counted within the file, so reading again gives the same ids; a row without
    observed_at was observed at ``cutoff``. A file with line breaks in cells is one task's work.
    """
    df = spark.read.option("header", True).option("multiLine", True).csv(path)
    names = set(df.columns)
    cell = lambda *n: F.coalesce(*(F.nullif(F.trim(F.col(f"`{x}`")), F.lit("")) for x in n if x in names), F.lit(None).cast("string"))
    pairs = F.map_from_arrays(F.array(*(F.lit(c) for c in df.columns)), F.array(*(F.col(f"`{c}`") for c in df.columns)))
    payload = F.to_json(F.map_filter(pairs, lambda k, v: v.isNotNull() & (F.trim(v) != "")))
    file = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    rows = df.select("*", F.col("_metadata.file_path").alias("__file"), file.alias("__stem"), payload.alias("__payload"), F.monotonically_increasing_id().alias("__id"))
    place = F.row_number().over(Window.partitionBy("__file").orderBy("__id")) - 1
    numbered = rows.withColumn("__place", F.concat_ws(":", "__stem", place.cast("string")))
    return _draft(numbered, {
        "provider_record_id": F.coalesce(cell("record_id"), F.col("__place")), "mode": F.when(F.lower(cell("mode")) == "discover", "discover").otherwise("update"), "content_type": F.lit("csv_row"),
        "subject_hint": cell("person", "subject_hint"), "occurred_at": cell("occurred_at"), "observed_at": F.coalesce(cell("observed_at"), cutoff.cast("string")), "source_url": cell("source_url"), "raw_json": F.col("__payload"),
    })


def read_feed(spark: SparkSession, path: str, row: str = "item") -> DataFrame:
    """RSS (``item``) or Atom (``entry``) files: news articles whose subjects are their categories."""
    schema = "guid string, id string, link string, title string, description string, summary string, pubDate string, published string, category array<string>"
    df = spark.read.format("xml").option("rowTag", row).option("ignoreNamespace", True).schema(schema).load(path)
    rfc = F.try_to_timestamp(F.regexp_replace("pubDate", "^[A-Za-z]+, ", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    when = F.coalesce(rfc, lenient_timestamp(F.coalesce("published", "pubDate")))
    body = F.to_json(F.struct("title", F.coalesce("summary", "description").alias("summary"), F.col("category").alias("subjects")))
    return _draft(df, {
        "provider_record_id": F.coalesce("guid", "id", "link"), "mode": F.lit("update"), "content_type": F.lit("news_article"), "subject_hint": F.try_element_at("category", F.lit(1)),
        "occurred_at": when, "observed_at": when, "source_url": F.col("link"), "raw_text": F.concat_ws(". ", "title", F.coalesce("summary", "description")), "raw_json": body,
    })


def about(feed: DataFrame, names: DataFrame) -> DataFrame:
    """Feed drafts of which a subject is one of ``names`` (column name), letter case aside."""
    subjects = F.from_json(F.get_json_object("raw_json", "$.subjects"), "array<string>")
    each = feed.withColumn("__subject", F.explode(F.array_distinct(F.transform(F.array_append(F.coalesce(subjects, F.array().cast("array<string>")), F.col("subject_hint")), F.lower))))
    matched = each.join(names.select(F.lower("name").alias("__subject")).distinct(), "__subject", "left_semi")
    return matched.drop("__subject").dropDuplicates()


def inline(spark: SparkSession, rows: list[dict], run: str) -> DataFrame:
    """Rows given by a caller, as drafts; ids default to run and place."""
    made = [{**{n: r.get(n) for n in _TEXT}, "provider_record_id": r.get("provider_record_id") or f"import:{run}:{i}", "content_type": r.get("content_type") or "csv_row"} for i, r in enumerate(rows)]
    text = spark.createDataFrame([tuple(m[n] for n in _TEXT) for m in made], ", ".join(f"{n} string" for n in _TEXT))
    return _draft(text, {n: F.col(n) for n in _TEXT})


def top_posts(posts: DataFrame, person: str, counts: list[str], k: int, tie: str, place: str | None = None) -> DataFrame:
    """Each person's k posts of most engagement, the sum of the counts that are numbers."""
    engagement = sum((F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in counts), F.lit(0.0))
    df = posts.withColumn("engagement", engagement)
    df = df if place is None else df.withColumn(place, listed(F.col(place)))
    w = Window.partitionBy(person).orderBy(F.desc("engagement"), tie)
    return df.withColumn("place_in_person", F.row_number().over(w)).filter(F.col("place_in_person") <= k)


class Registry:
    """Sources by provider; those enabled in the source table are read, those without a reader give no drafts."""

    def __init__(self) -> None:
        self.readers: dict[str, Callable[[SparkSession], DataFrame]] = {}

    def add(self, provider: str, reader: Callable[[SparkSession], DataFrame]) -> None:
        self.readers[provider] = reader

    def read(self, spark: SparkSession, enabled: list[str]) -> DataFrame:
        """All enabled sources' drafts with their provider, in the order of registration (batch_seq)."""
        out = spark.createDataFrame([], DRAFT).select(F.lit("").alias("provider"), F.lit(0).alias("batch_seq"), "*")
        for i, (provider, reader) in enumerate(self.readers.items()):
            if provider in enabled:
                out = out.unionByName(reader(spark).select(F.lit(provider).alias("provider"), F.lit(i).alias("batch_seq"), *_TEXT))
        return out

    def health(self, spark: SparkSession, enabled: list[str]) -> DataFrame:
        """(provider, status, records, error): a source that can't be read is 'failed' and doesn't stop the others."""
        rows = []
        for provider, reader in self.readers.items():
            if provider not in enabled:
                rows.append((provider, "disabled", 0, None))
                continue
            try:
                rows.append((provider, "ok", reader(spark).count(), None))
            except Exception as e:  # noqa: BLE001
                rows.append((provider, "failed", 0, str(e)[:200]))
        return spark.createDataFrame(rows, "provider string, status string, records bigint, error string")


def search_queries(rules: list[dict], site: str = "profiles.example/in", most: int = 5) -> dict[str, str]:
    """The search string of each active rule that names titles: a site, any of its titles, any of its places."""
    either = lambda words: "(" + " OR ".join(f"{w!r}" for w in words[:most]) + ")"
    parts = lambda r: [f"site:{site}", either(r["titles"]), *([either(r["geographies"])] if r.get("geographies") else [])]
    return {r["name"]: " ".join(parts(r)) for r in rules if r.get("active", True) and r.get("titles")}


def search_drafts(results: DataFrame, query: str, subject: Column, as_of: Column) -> DataFrame:
    """Search results (url, title, content, published) as drafts: the address is the id, a result without a date is of ``as_of``."""
    when = F.coalesce(lenient_timestamp(F.col("published")), as_of)
    body = F.to_json(F.struct("title", "content", F.lit(query).alias("query")))
    return _draft(results, {
        "provider_record_id": F.col("url"), "mode": F.lit("discover"), "content_type": F.lit("news_article"), "subject_hint": subject, "occurred_at": when, "observed_at": as_of,
        "source_url": F.col("url"), "raw_text": F.concat_ws(". ", "title", "content"), "raw_json": body,
    })
