"""Company names: standardising, matching neighbours, and resolving by a rule table."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from importlib import resources

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.text import char_cosine, require, squish, strip
from plumbline.operators.graph import checkpointed

#: Legal forms, taken out wherever they stand (also inside words), first alternative first.
LEGAL_FORMS = ["bv", r"b\.v\.", " b v", " n v", " bv", " nv", r"n\.v\.", "vof", r"v\.o\.f\.", "cv", " llc", " ltd", "coöperatie", "stichting", "vereniging", " inc$", " usa", " b u", "limited", "gmbh", " sarl"]
#: Whole words and what they become, in this order.
SHORT_FORMS = {
    "technologies?": "tech", "technology": "tech", "research": "tech", "management": "mgt", "solutions?": "sol", "consulting": "consult", "international": "int",
    "services?": "serv", "holding": "hold", "group": "grp", "engineering": "eng", "holdings": "hold", "université": "univ", "university": "univ", "comany": "co", "company": "co", "development": "dev",
}


def clean_name(name: Column) -> Column:
    """The name in lower case without legal forms and punctuation, with common words shortened."""
    out = F.regexp_replace(F.lower(name), "|".join(LEGAL_FORMS), " ")
    out = strip(F.regexp_replace(out, r"[\p{P}-]", " "))
    for word, short in SHORT_FORMS.items():
        out = F.regexp_replace(out, rf"(?U)\b{word}\b", short)
    return squish(out)


def sorted_tokens(clean: Column) -> Column:
    return F.array_join(F.array_sort(F.split(clean, " +")), " ")


def clean_and_match_companies(df: DataFrame, name_col: str, similarity_threshold: float = 0.85, tie_col: str | None = None) -> DataFrame:
    """(Initial_name, Clean, Clean2, Matched), ordered by Clean2.

    Each name is compared with the next one in the order of Clean2 (then tie_col, then the name); Matched is that one's original name if the cosine of their character counts reaches the
    threshold. Null or empty names match nothing.

    The order is total, but no single task sees it whole: rows are range-partitioned by Clean2, ``lead`` runs within each range, and the first row of the next range that isn't empty is fetched for each range's last
    row. The ranges are written once in the shared folder.
    """
    require(df.columns, name_col, *([tie_col] if tie_col else []))
    name = F.col(name_col).cast("string")
    rows = df.select(name.alias("Initial_name"), (F.col(tie_col).cast("string") if tie_col else name).alias("__tie"))
    rows = rows.withColumn("Clean", clean_name(F.col("Initial_name"))).withColumn("Clean2", sorted_tokens(F.col("Clean")))
    order = [F.col("Clean2").asc_nulls_last(), F.col("__tie").asc_nulls_last(), F.col("Initial_name").asc_nulls_last()]
    if tie_col:
        order[1] = F.col("__tie").try_cast("bigint").asc_nulls_last()
        order.insert(2, F.col("__tie").asc_nulls_last())
    # ranges are drawn from a sample each time they are computed, so they are written once and read for rows and heads alike
    placed = checkpointed(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    own = Window.partitionBy("__part").orderBy(*order)
    here = placed.withColumn("__next", F.lead(F.struct("Clean2", "Initial_name")).over(own)).withColumn("__n", F.row_number().over(own))
    firsts = here.where("__n = 1").select("__part", F.struct("Clean2", "Initial_name").alias("__head"))
    heads = firsts.withColumn("__after", F.lead("__head").over(Window.orderBy("__part"))).select("__part", "__after")  # one row a range
    joined = here.join(F.broadcast(heads), "__part", "left").withColumn("__next", F.coalesce("__next", "__after"))
    matched = F.when(F.round(char_cosine(F.col("Clean2"), F.col("__next.Clean2")), 12) >= similarity_threshold, F.col("__next.Initial_name"))
    return joined.withColumn("Matched", matched).orderBy("Clean2", "__tie", "Initial_name").select("Initial_name", "Clean", "Clean2", "Matched")


RULE_SCHEMA = "priority int, type string, tokens array<string>, pattern string, canonical string, place int"


def builtin_rules() -> list[tuple]:
    with resources.files("plumbline.sources").joinpath("data/company_rules.tsv").open(encoding="utf-8", newline="") as f:
        rows = list(csv.DictReader(f, delimiter="\t", quoting=csv.QUOTE_NONE))
    return sorted(((int(r["priority"]), r["kind"], r["needles"].split(" & "), None, r["canonical"], int(r["place"])) for r in rows), key=lambda r: r[5])


def load_company_rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The rule table (priority, type, tokens, pattern, canonical, place): the packaged one, or a JSON-lines file of these fields. Rules are data and are never executed."""
    if path is None:
        return spark.createDataFrame(builtin_rules(), RULE_SCHEMA)
    rules = spark.read.schema(RULE_SCHEMA.replace(", place int", "")).json(path)
    require(rules.columns, "priority", "type", "tokens", "canonical")
    if rules.where("priority is null or type is null or tokens is null or canonical is null").limit(1).count():
        raise ValueError("a rule lacks priority, type, tokens or canonical")
    return rules.withColumn("place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))


def usable_rules(rules: list[tuple], strict: bool) -> list[tuple[str, list[str], str | None, str]]:
    """(type, tokens, pattern, canonical) of the rules whose patterns compile; ValueError at one that doesn't if strict."""
    usable = []
    for _, kind, tokens, pattern, canonical, place in rules:
        try:
            for p in [*tokens, *([pattern] if pattern else [])]:
                re.compile(p)
            usable.append((kind, tokens, pattern, canonical))
        except re.error as e:
            if strict:
                raise ValueError(f"rule {place} ({canonical}) doesn't compile: {e}") from e
    return usable


def needed_texts(kind: str, tokens: list[str]) -> list[str] | None:
    """Texts of which a name in lower case must hold one for the rule to match; None if they can't be told from the patterns."""

    def plain(token: str) -> list[str] | None:
        parts = [re.sub(r"^(?:\\b|\^)+|(?:\\b|\$)+$", "", x) for x in token.split("|")]
        return [x.lower() for x in parts] if all(x and x.isascii() and not re.search(r"[\\^$.?*+(){}\[\]]", x) for x in parts) else None

    texts = [plain(t) for t in tokens]
    if kind == "ALL":
        return max((t for t in texts if t is not None), key=lambda t: min(map(len, t)), default=None)
    return None if None in texts else [x for t in texts for x in t]


#: Letters of a needed text that are looked up; shorter texts are looked up whole.
ANCHOR = 3


def anchors(needed: list[list[str] | None]) -> tuple[dict[str, list[int]], list[int]]:
    """(places of the rules by the first letters of their needed texts, places of the rules without)."""
    by_start: dict[str, list[int]] = {}
    for k, texts in enumerate(needed):
        for start in {x[:ANCHOR] for x in texts or []}:
            by_start.setdefault(start, []).append(k)
    return by_start, [k for k, texts in enumerate(needed) if texts is None]


def possible(low: str, by_start: dict[str, list[int]], always: list[int]) -> list[int]:
    """Places of the rules that may match a name in lower case, in order."""
    found = set(always)
    for n in range(1, ANCHOR + 1):
        for i in range(len(low) - n + 1):
            if (k := by_start.get(low[i : i + n])) is not None:
                found.update(k)
    return sorted(found)


def apply_company_rules(df: DataFrame, name_col: str, rules: DataFrame, strict: bool = True) -> DataFrame:
    """df with ``canonical``: of the rules that match, that of the lowest priority number, then place; null without one.

    A rule matches if all (ALL) or any (ANY) of its tokens are found as patterns, without regard to case, and its own pattern, where it has one. Patterns that don't compile are an error,
    or with strict=False skipped. Each distinct name is resolved once, in Arrow batches with the patterns compiled once a task.
    """
    require(df.columns, name_col)
    table = [r.asDict() for r in rules.orderBy("priority", "place").collect()]  # a rule table is small by nature
    usable = usable_rules([(r["priority"], r["type"], r["tokens"], r["pattern"], r["canonical"], r["place"]) for r in table], strict)

    @F.pandas_udf("string")
    def resolve(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = [(needed_texts(kind, tokens), all if kind == "ALL" else any, [re.compile(t, re.I) for t in tokens], re.compile(p, re.I) if p else None, canonical) for kind, tokens, p, canonical in usable]
        by_start, always = anchors([c[0] for c in compiled])

        def first(s: str) -> str | None:
            low = s.lower() if s.isascii() else None  # other letters fold in ways of their own
            for needed, rule, tokens, p, canonical in compiled if low is None else (compiled[k] for k in possible(low, by_start, always)):
                if (low is None or needed is None or any(x in low for x in needed)) and rule(t.search(s) for t in tokens) and (p is None or p.search(s)):
                    return canonical
            return None

        for batch in batches:
            yield pd.Series([first(s) if isinstance(s, str) else None for s in batch])

    # names are few bytes and much work: by their size alone they would be put into a task or two
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    names = df.select(F.col(name_col).alias("__name")).where("__name is not null").repartition(tasks, "__name").distinct().withColumn("canonical", resolve("__name"))
    return df.drop("canonical").join(names, F.col(name_col) == F.col("__name"), "left").drop("__name")
