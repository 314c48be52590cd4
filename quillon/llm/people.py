"""Candidates of a feed matched to the people behind them: the tables' attributes, tokens and the deciding rule."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import canonical
from quillon.llm.matching import MOST_BITS, TABLES, Space, View, blocked, both_sides, confident, cosine, curve, side
from quillon.llm.names import grams, parts, verified
from quillon.operators.resolve import live_ids
from quillon.session import cut, spread, table

SIDE = "record string, attribute string, value string, tokens array<string>"
NAME_VIEWS = {"family": View(("family",), each=True), "name": View(("name",))}
#: What a pair's vectors are made of: all but the addresses, which are kept apart as the truth that confidence is fitted on.
RECORD_VIEW = {"record": View(("name", "employer", "place"))}
ADDRESSES = ("url", "email")
#: Candidates' names whose pairs the confidence is fitted on, at most.
LABELLED_NAMES = 1_000
#: Agreeing employers that, with the place, stand for an address.
ENOUGH = 2


def address(url: str | None) -> str:
    """A profile address without scheme, www, query, fragment, outer blanks, last slash and letter case."""
    if not isinstance(url, str):
        return ""
    text = re.sub(r"^(?:[a-z]+:)?//", "", url.strip().lower())
    return re.split(r"[?#]", text.removeprefix("www."))[0].strip().rstrip("/")


def mail(email: str | None) -> str:
    return email.strip().lower() if isinstance(email, str) else ""


def attributes(df: DataFrame, companies: list, places: list) -> DataFrame:
    """(record, name, payload): canonical values of rows record, name, urls, emails, employers, org_ids, places (arrays)."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        c = canonical.mapper("companies", companies, canonical.COMPANIES)
        p = canonical.mapper("places", places, canonical.PLACES)
        lists = lambda v: [] if v is None else [x for x in v if isinstance(x, str) and x.strip()]
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                orgs = {i for e in lists(r.employers) if (i := c.find(e))} | set(lists(r.org_ids))
                made = {
                    "name": r.name if isinstance(r.name, str) else "",
                    "urls": sorted({a for u in lists(r.urls) if (a := address(u))}),
                    "emails": sorted({m for e in lists(r.emails) if (m := mail(e))}),
                    "orgs": sorted(orgs),
                    "places": sorted({i for v in lists(r.places) if (i := p.find(v))}),
                }
                out.append((r.record, made["name"], json.dumps(made)))
            yield pd.DataFrame(out, columns=["record", "name", "payload"])

    return spread(df, "record").mapInPandas(run, "record string, name string, payload string")


def _name_rows(rid: str, name: str) -> list[tuple]:
    """A name's q-grams, and those of its longest word as the attribute ``family``."""
    words = parts(name)
    if not words:
        return []
    family = max(words, key=lambda w: (len(w), w))
    return [(rid, kind, of, sorted("n:" + g for g in grams(of))) for kind, of in (("name", name), ("family", family))]


def name_tokens(names: DataFrame) -> DataFrame:
    """SIDE rows of distinct names (column name), each its own record."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame([r for n in batch["name"] for r in _name_rows(n, n)], columns=["record", "attribute", "value", "tokens"])

    return spread(names.select("name").filter("name <> ''").distinct()).mapInPandas(run, SIDE)


def tokens(sides: DataFrame) -> DataFrame:
    """SIDE rows of payloads."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            out = []
            for rid, payload in zip(batch["record"], batch["payload"]):
                v = json.loads(payload)
                out += _name_rows(rid, v["name"])
                for kind, key, mark in (("url", "urls", "u:"), ("email", "emails", "e:"), ("employer", "orgs", "o:"), ("place", "places", "p:")):
                    out += [(rid, kind, x, [mark + x]) for x in v[key]]
            yield pd.DataFrame(out, columns=["record", "attribute", "value", "tokens"])

    return spread(sides, "record").mapInPandas(run, SIDE)


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Payloads of the candidates and of the live people."""
    companies = canonical.read_list(table(spark, d, "organization"), "organization_id", "canonical_name")
    places = canonical.read_list(table(spark, d, "place_ref"), "place_id", "name", "country")
    c = table(spark, d, "er_candidate")
    none = F.lit(None).cast("array<string>")
    left = c.select(
        F.col("candidate_id").alias("record"), "name", F.array("linkedin_url").alias("urls"), F.array("email").alias("emails"),
        F.concat(F.array("current_employer"), F.coalesce("prior_employers", F.array().cast("array<string>"))).alias("employers"), none.alias("org_ids"), F.array("geography").alias("places"),
    )
    person = table(spark, d, "person")
    ids = cut(live_ids(person))
    own = person.join(ids, "person_id").groupBy(F.col("live_id").alias("record")).agg(
        F.max(F.when(F.col("merged_into_id").isNull(), F.col("canonical_name"))).alias("name"),
        F.collect_set("primary_linkedin_url").alias("urls"), F.collect_set("primary_email").alias("emails"),
        F.array_compact(F.array(F.max(F.when(F.col("merged_into_id").isNull(), F.col("primary_location"))))).alias("places"),
    )
    jobs = table(spark, d, "employment").join(ids, "person_id").groupBy(F.col("live_id").alias("record")).agg(F.collect_set("organization_id").alias("org_ids"))
    right = own.join(jobs, "record", "left").select("record", "name", "urls", "emails", none.alias("employers"), "org_ids", "places").filter("name is not null")
    return cut(attributes(left, companies, places)), cut(attributes(right, companies, places))


def evidence(sides_: DataFrame, tok: DataFrame) -> DataFrame:
    """(record, name, attribute, value, key): what may speak for a person beside the name, key being a hash of it."""
    own = tok.filter(F.col("attribute").isin(*ADDRESSES, "employer")).select("record", "attribute", "value").distinct()
    return own.join(sides_.select("record", "name").filter("name <> ''"), "record").withColumn("key", F.xxhash64("attribute", "value"))


def named(space: Space, left: DataFrame, right: DataFrame) -> DataFrame:
    """(record, view, vector, keys) of the distinct names of both sides, marked L and R, each its own record."""
    return cut(space.vectors(both_sides(name_tokens(left), name_tokens(right)), NAME_VIEWS, MOST_BITS, TABLES))


def met_names(made: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(left_name, right_name) that meet, repeated ones too: names of records that share a value meet where their vectors fall
    on the same side of a table's hyperplanes. Names and not records are blocked, so a name that a third of all records bear
    is one row."""
    of = lambda e, name: e.select(F.col("name").alias(name), F.col("key").alias("value")).distinct()
    left = side(made, "L").join(a.select(F.col("name").alias("record")).distinct(), "record", "left_semi")
    return blocked(left, side(made, "R"), cut(of(a, "left_record")), cut(of(b, "right_record"))).toDF("left_name", "right_name")


def _of(e: DataFrame, side_: str) -> DataFrame:
    return e.select(F.col("record").alias(f"{side_}_record"), F.col("name").alias(f"{side_}_name"), "attribute", "key")


def _each(e: DataFrame, tok: DataFrame, side_: str) -> DataFrame:
    """(record, addresses, places) of a side, as arrays of a record's few values."""
    of = lambda *kinds: F.collect_set(F.when(F.col("attribute").isin(*kinds), F.col("value")))
    by = tok.groupBy("record").agg(of(*ADDRESSES).alias(f"{side_}_addresses"), of("place").alias(f"{side_}_places"))
    return e.select("record").distinct().join(by, "record").withColumnRenamed("record", f"{side_}_record")


def labelled(made: DataFrame, a: DataFrame, b: DataFrame, each: tuple[DataFrame, DataFrame], vectors: DataFrame) -> DataFrame:
    """(left_record, right_record, cosine, truth) on which confidence is fitted: pairs that share an employer and whose names
    meet, of LABELLED_NAMES names by least hash, where both sides give addresses; truth is that they share one.

    Neither the vectors nor what makes the pairs meet knows the addresses.
    """
    few = cut(a.select("name").distinct().orderBy(F.xxhash64("name"), "name").limit(LABELLED_NAMES))
    work = lambda e: e.filter("attribute = 'employer'")
    mine = cut(work(a).join(few, "name", "left_semi"))
    met = cut(met_names(made, mine, work(b)).distinct())
    pairs = _of(mine, "left").join(met, "left_name").join(_of(work(b), "right"), ["right_name", "attribute", "key"]).select("left_record", "right_record").distinct()
    known = pairs.join(each[0], "left_record").join(each[1], "right_record").filter("size(left_addresses) > 0 and size(right_addresses) > 0")
    known = known.select("left_record", "right_record", F.arrays_overlap("left_addresses", "right_addresses").alias("truth"))
    return cosine(cut(known), side(vectors, "L"), side(vectors, "R"), "record")


def matches(spark: SparkSession, d: str, confidence: bool = True) -> DataFrame:
    """(candidate_id, person_id, cosine, confidence, name_similarity, addresses, employers, places, qualified).

    Pairs whose names agree and that share an address or employer; a name alone never counts. Records meet on the name and
    the shared value together, so neither a frequent name nor a frequent employer makes all pairs. Confidence is read from
    the cosine of name, employers and place, see labelled(); without ``confidence`` its curve isn't fitted and it is null.
    """
    left, right = sides(spark, d)
    a, b = cut(tokens(left)), cut(tokens(right))
    space = Space(a, b)
    ea, eb = cut(evidence(left, a)), cut(evidence(right, b))
    made = named(space, left, right)
    agreed = cut(verified(met_names(made, ea, eb).toDF("name", "center"), right.select("name").distinct().count()).toDF("left_name", "right_name", "name_similarity"))
    met = _of(ea, "left").join(agreed, "left_name").join(_of(eb, "right"), ["right_name", "attribute", "key"])
    count = lambda *kinds: F.sum(F.col("attribute").isin(*kinds).cast("int"))
    pairs = met.groupBy("left_record", "right_record").agg(F.max("name_similarity").alias("name_similarity"), count(*ADDRESSES).alias("addresses"), count("employer").alias("employers"))
    each = _each(ea, a, "left"), _each(eb, b, "right")
    pairs = pairs.join(each[0], "left_record").join(each[1], "right_record").withColumn("places", F.size(F.array_intersect("left_places", "right_places")))
    qualified = (F.col("addresses") > 0) | ((F.col("employers") >= ENOUGH) & (F.col("places") > 0))
    pairs = cut(pairs.withColumn("qualified", qualified).drop("left_places", "right_places", "left_addresses", "right_addresses"))
    vectors = cut(space.vectors(both_sides(a, b), RECORD_VIEW))
    scored = cosine(pairs, side(vectors, "L"), side(vectors, "R"), "record")
    if not confidence:
        return scored.withColumn("confidence", F.lit(None).cast("double")).withColumnsRenamed({"left_record": "candidate_id", "right_record": "person_id"})
    intercept, slope, _, _ = curve(labelled(made, ea, eb, each, vectors), "cosine", "truth")
    return confident(scored, "cosine", intercept, slope).withColumnsRenamed({"left_record": "candidate_id", "right_record": "person_id"})


def best(found: DataFrame) -> DataFrame:
    """Of a candidate's qualified people the one who agrees in most, then the likeliest by vectors, then by name and least person_id."""
    most = F.struct(-(F.col("addresses") + F.col("employers") + F.col("places")), -F.coalesce("cosine", F.lit(-1.0)), -F.col("name_similarity"), F.col("person_id"))
    row = F.struct("person_id", "confidence", "cosine", "addresses", "employers", "places")
    return found.filter("qualified").groupBy("candidate_id").agg(F.min_by(row, most).alias("m")).select("candidate_id", "m.*")
