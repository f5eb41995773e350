"""Replacing accepted spans by tokens, the maps that this needs, and the check of the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spans import accepted, entity_groups, numbered_groups

#: What a document's replacements look like in order of their place.
PIECE = "array<struct<start:int,end:int,token:string>>"


def with_tokens(spans: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Accepted spans with their group's token; only groups with an accepted span are numbered."""
    own = accepted(spans)
    tokens = numbered_groups(entity_groups(own, id_col=id_col), id_col=id_col)
    return own.join(tokens.select(id_col, "entity_group_id", "token"), [id_col, "entity_group_id"])


def offset_map(tokens: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(original_start, original_end, anonymized_start, anonymized_end, token, category) of each replacement."""
    before = Window.partitionBy(id_col).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    grown = F.coalesce(F.sum(F.length("token") - (F.col("end") - F.col("start"))).over(before), F.lit(0)).cast("int")
    rows = tokens.withColumn("anonymized_start", F.col("start") + grown)
    return rows.select(id_col, F.col("start").alias("original_start"), F.col("end").alias("original_end"), "anonymized_start", (F.col("anonymized_start") + F.length("token")).alias("anonymized_end"), "token", "category")


def replace_pieces(text: Column, pieces: Column) -> Column:
    """``text`` with each (start, end, token) replaced; pieces are ordered and do not overlap."""
    done = F.aggregate(
        pieces,
        F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at")),
        lambda a, p: F.struct(F.concat(a["out"], F.array(F.substr(text, a["at"] + 1, p["start"] - a["at"]), p["token"])).alias("out"), p["end"].alias("at")),
    )
    return F.concat(F.array_join(done["out"], ""), F.substr(text, done["at"] + 1, F.length(text)))


def anonymize(docs: DataFrame, tokens: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, anonymized_text, n_replaced) of every document; ``tokens`` from ``with_tokens``."""
    pieces = tokens.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("start", "end", "token"))).alias("pieces"))
    rows = docs.select(id_col, text_col).join(pieces, id_col, "left")
    text = F.when(F.col("pieces").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform("pieces", lambda p, i: F.concat(
        F.substr(F.col(text_col), F.when(i == 0, 1).otherwise(F.get("pieces", i - 1)["end"] + 1), p["start"] - F.when(i == 0, 0).otherwise(F.get("pieces", i - 1)["end"])), p["token"])), ""))
    tail = F.when(F.col("pieces").isNull(), "").otherwise(F.substr(F.col(text_col), F.element_at("pieces", -1)["end"] + 1, F.length(text_col)))
    return rows.select(id_col, F.concat(text, tail).alias("anonymized_text"), F.coalesce(F.size("pieces"), F.lit(0)).alias("n_replaced"))


def map_entries(tokens: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """One row per document and token: category, canonical text, distinct surface forms in sorted order."""
    return tokens.groupBy(id_col, "token").agg(F.min_by("category", "idx").alias("category"), F.min_by("canonical_text", "idx").alias("canonical_text"), F.array_sort(F.collect_set("text")).alias("variants"))


def replacement_maps(entries: DataFrame, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One map per document: entries by token, and the document's SHA-256 as fingerprint."""
    kind = F.struct("token", "category", "canonical_text", "variants")
    per = entries.groupBy(id_col).agg(F.sort_array(F.collect_list(kind)).alias("entries"))
    return docs.select(id_col, F.sha2(F.col(text_col), 256).alias("document_fingerprint")).join(per, id_col)


def leaks(anonymized: DataFrame, entries: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Documents with a flag whether any replaced value is still in their text."""
    values = entries.select(id_col, F.explode(F.concat(F.array("canonical_text"), "variants")).alias("value")).filter("value <> ''").groupBy(id_col).agg(F.collect_set("value").alias("values"))
    rows = anonymized.join(values, id_col, "left")
    return rows.select(id_col, F.coalesce(F.exists("values", lambda v: F.contains(F.col("anonymized_text"), v)), F.lit(False)).alias("leaks"))


def largest_map(items: DataFrame, *, map_col: str = "entries", order_col: str = "idx", by: str | None = None) -> DataFrame:
    """The map with most entries; the first of equals."""
    best = F.max_by(F.struct(*items.columns), F.struct(F.size(map_col), -F.col(order_col)))
    grouped = items.groupBy(by) if by else items.groupBy()
    return grouped.agg(best.alias("m")).select("m.*")


#: Stand-ins for the pseudonym mode; inflection is not attempted.
GIVEN = ("Adam", "Anna", "Ewa", "Jan", "Maria", "Marek", "Piotr", "Zofia")
SURNAMES = ("Brzoza", "Dolina", "Jawor", "Kalina", "Lipa", "Olcha", "Sosna", "Wierzba")


def pseudonym(category: Column, canonical: Column, salt: str = "") -> Column:
    """A deterministic stand-in: invented names for people and companies, digits for digits, else null (keeps the token)."""
    h = F.xxhash64(F.lit(salt), category, canonical)
    pick = lambda names, shift: F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(F.shiftright(h, shift), F.lit(len(names))) + 1).cast("int"))
    digits = F.array_join(F.transform(F.split(canonical, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.pmod(F.xxhash64(h, i), F.lit(10)).cast("string")).otherwise(c)), "")
    return F.when(category == "PERSON", F.concat_ws(" ", pick(GIVEN, 0), pick(SURNAMES, 16))).when(category == "COMPANY", F.concat(pick(SURNAMES, 8), F.lit(" sp. z o.o."))).when(category.isin("PESEL", "NIP", "REGON", "PHONE", "BANK_ACCOUNT", "PAYMENT_CARD", "KRS"), digits)


def pseudonymize(tokens: DataFrame, *, id_col: str = "doc_id", salt: str = "") -> DataFrame:
    """Tokens with stand-ins instead where there are some; label keeps the token, fake_forms leads back."""
    fake = pseudonym(F.col("category"), F.col("canonical_text"), salt)
    rows = tokens.withColumn("fake", fake).withColumn("label", F.col("token"))
    return rows.withColumn("token", F.coalesce("fake", "token")).withColumn("fake_forms", F.when(F.col("fake").isNotNull(), F.create_map("fake", "canonical_text"))).drop("fake")
