"""Patent records, one JSON object a line (plain or gzip), as tables.

Titles and abstracts may be one object or an array of them, so records are read as VARIANT. Dates stay strings. Malformed and blank lines are dropped, and counted by ``max_records``.
Every function takes the lines as a DataFrame (``value``) too, so that it also runs on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, max_records: int | None = None) -> DataFrame:
    """The lines of a file or folder; with max_records the first so many physical lines, in order of file and place."""
    if max_records is None:
        return spark.read.text(path)
    placed = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("place"))
    return placed.orderBy("file_path", "file_block_start", "place").limit(max_records).select("value")


#: An object gives a struct, if without values; anything else gives null.
_IS_OBJECT = "try_variant_get(v, '$', 'struct<lens_id: variant>') is not null"


def _parsed(lines: DataFrame, *kept: str) -> DataFrame:
    """v beside the kept columns. It comes out of a generator, so that a line is parsed once: filters on a plain expression are carried below joins, and evaluate it again there."""
    return lines.select(*kept, F.explode(F.array(F.try_parse_json("value"))).alias("v"))


def parse(lines: DataFrame) -> DataFrame:
    """(v): the well-formed JSON objects."""
    return _parsed(lines).where(_IS_OBJECT)


def bad_records(lines: DataFrame) -> DataFrame:
    """(value): the lines that parse drops."""
    return _parsed(lines, "value").where(f"not ({_IS_OBJECT})").select("value")


def extract(path: str, kind: str = "string", v: str = "v") -> Column:
    """The value at a JSON path, null where any step is missing."""
    return F.try_variant_get(F.col(v), f"$.{path}", kind)


_TEXTS = "array<struct<lang: string, text: string>>"


def _in_english(many: str, path: str) -> Column:
    """One object's text whatever its language; of an array (the column many) the first English text, else the first element's."""
    english = F.try_element_at(F.filter(many, lambda t: (t["lang"] == "en") & t["text"].isNotNull()), F.lit(1))["text"]
    return F.coalesce(english, F.try_element_at(many, F.lit(1))["text"], extract(f"{path}.text"))


_APPLICANTS = "array<struct<extracted_name: struct<value: string>, residence: string, extracted_address: string>>"
_INVENTORS = "array<struct<sequence: int, extracted_name: struct<value: string>, residence: string>>"
_CLASSES = "array<struct<symbol: string, classification_value: string, classification_symbol_position: string>>"


def _strings(array: str, name: str | None) -> Column:
    """The entries' values that aren't null: names, or a field."""
    return F.filter(F.transform(array, lambda x: x["extracted_name"]["value"] if name is None else x[name]), lambda s: s.isNotNull())


def _joined(values: str) -> Column:
    """Joined by "; "; null if there is none."""
    return F.when(F.size(values) > 0, F.array_join(values, "; "))


def _symbols(entries: str) -> Column:
    """IPC symbols joined by "; ": null without entries, "" if no entry has a symbol."""
    return F.when(F.size(entries) > 0, F.array_join(F.transform(entries, lambda x: x["symbol"]), "; "))


def patent_info(lines: DataFrame, addresses: bool = False) -> DataFrame:
    """20 columns a patent; with addresses also applicant_addresses and applicant_countries."""
    extra = [_joined("__addresses").alias("applicant_addresses"), _joined("__countries").alias("applicant_countries")] if addresses else []
    # what is used more than once is a column of its own, else it would be taken out of the record each time
    arrays = parse(lines).select(
        "v", extract("biblio.invention_title", _TEXTS).alias("__titles"), extract("abstract", _TEXTS).alias("__abstracts"), extract("biblio.parties.applicants", _APPLICANTS).alias("__applicants"),
        extract("biblio.parties.inventors", _INVENTORS).alias("__inventors"), extract("biblio.classifications_ipcr.classifications", _CLASSES).alias("__classes"),
    )
    more = [_strings("__applicants", "extracted_address").alias("__addresses"), _strings("__applicants", "residence").alias("__countries")] if addresses else []
    values = arrays.select("v", "__titles", "__abstracts", "__classes", _strings("__applicants", None).alias("__names"), _strings("__inventors", None).alias("__people"), *more)
    return values.select(
        *[extract(c).alias(c) for c in ("lens_id", "jurisdiction", "doc_number", "kind", "date_published", "lang")],
        _in_english("__titles", "biblio.invention_title").alias("title"),
        _in_english("__abstracts", "abstract").alias("abstract"),
        extract("biblio.application_reference.doc_number").alias("app_doc_number"),
        extract("biblio.application_reference.date").alias("app_date"),
        F.coalesce(extract("biblio.priority_claims.earliest_claim.date"), extract("biblio.priority_claims.claims[0].date")).alias("priority_date"),
        _joined("__names").alias("applicants"),
        _joined("__people").alias("inventors"),
        _symbols("__classes").alias("ipc_classifications"),
        extract("legal_status.patent_status").alias("patent_status"),
        extract("legal_status.granted", "boolean").alias("granted"),
        extract("legal_status.grant_date").alias("grant_date"),
        F.coalesce(extract("biblio.cited_by.patent_count", "bigint"), F.lit(0).cast("bigint")).alias("cited_by_count"),
        extract("families.simple_family.size", "bigint").alias("simple_family_size"),
        extract("families.extended_family.size", "bigint").alias("extended_family_size"),
        *extra,
    )


def applicants(lines: DataFrame) -> DataFrame:
    """One row an applicant; sequence is the place in the record."""
    each = parse(lines).select(extract("lens_id").alias("lens_id"), F.posexplode(extract("biblio.parties.applicants", _APPLICANTS)).alias("pos", "e"))
    return each.select("lens_id", (F.col("pos") + 1).alias("sequence"), F.col("e.extracted_name.value").alias("name"), F.col("e.residence").alias("residence"), F.col("e.extracted_address").alias("address"))


def inventors(lines: DataFrame) -> DataFrame:
    """One row an inventor; sequence is the record's own, else the place."""
    each = parse(lines).select(extract("lens_id").alias("lens_id"), F.posexplode(extract("biblio.parties.inventors", _INVENTORS)).alias("pos", "e"))
    return each.select("lens_id", F.coalesce("e.sequence", F.col("pos") + 1).alias("sequence"), F.col("e.extracted_name.value").alias("name"), F.col("e.residence").alias("residence"))


def _classes(lines: DataFrame, path: str, system: str) -> DataFrame:
    each = parse(lines).select(extract("lens_id").alias("lens_id"), F.posexplode(extract(path, _CLASSES)).alias("pos", "e"))
    return each.select(
        "lens_id", F.lit(system).alias("classification_system"), F.col("e.symbol").alias("symbol"), F.col("e.classification_value").alias("classification_value"),
        F.col("e.classification_symbol_position").alias("classification_symbol_position"), (F.col("pos") + 1).alias("sequence"),
    )


def ipc_classes(lines: DataFrame) -> DataFrame:
    """One row an IPC entry."""
    return _classes(lines, "biblio.classifications_ipcr.classifications", "IPCR").drop("classification_symbol_position")


def cpc_classes(lines: DataFrame) -> DataFrame:
    """One row a CPC entry."""
    return _classes(lines, "biblio.classifications_cpc.classifications", "CPC")
