"""Choosing the map that belongs to a returned text, without guessing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions import names as N
from ..scratch import Scratch

ENTRY = "struct<token:string,category:string,canonical_text:string,variants:array<string>,fake_forms:map<string,string>>"


def parse_maps(rows: DataFrame, *, json_col: str = "json", strict: bool = True) -> DataFrame:
    """Adds ``entries``; null where the JSON is no map.

    The map may be bare or wrapped in ``map``.  Strictly, every entry needs token, canonical text and category
    as strings; leniently, the entries need only be an array.
    """
    text = F.col(json_col)
    variant = F.try_parse_json(text)
    inner = F.coalesce(F.try_variant_get(variant, "$.map", "variant"), variant)
    items = F.try_variant_get(inner, "$.entries", "array<variant>")
    is_text = lambda v, key: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")) == "STRING", F.lit(False))
    good = F.forall(items, lambda v: is_text(v, "token") & is_text(v, "canonical_text") & is_text(v, "category")) if strict else items.isNotNull()
    entries = F.transform(items, lambda v: F.struct(
        F.try_variant_get(v, "$.token", "string").alias("token"), F.try_variant_get(v, "$.category", "string").alias("category"), F.try_variant_get(v, "$.canonical_text", "string").alias("canonical_text"),
        F.try_variant_get(v, "$.variants", "array<string>").alias("variants"), F.try_variant_get(v, "$.fake_forms", "map<string,string>").alias("fake_forms")))
    return rows.withColumn("entries", F.when(items.isNotNull() & good, entries))


def candidates(adjacent: DataFrame, remembered: DataFrame, session: DataFrame | None = None) -> DataFrame:
    """All candidate maps with their rank: the session's, those beside the file in their order, then remembered ones, newest first."""
    parts = [(session, 0, F.lit(0).cast("long")), (adjacent, 1, F.col("idx").cast("long")), (remembered, 2, -F.col("saved_at").cast("long"))]
    out = None
    for part, rank, order in parts:
        if part is not None:
            own = part.withColumns({"source_rank": F.lit(rank), "order_": order})
            out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out.withColumn("recency_rank", F.row_number().over(Window.partitionBy("file_id").orderBy("source_rank", "order_", "map_id"))).drop("order_")


def forms_in(files: DataFrame, entries: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """(file_id, by, form): the fake forms of the maps of a file's ``by`` that its text contains.

    Forms meet texts by their first word, without the text; only then is a text held against its own candidates.  A form
    may start inside a word, so its first word need only end one, and one that ends with its first word may lie within one.
    """
    word = r"[^\s\p{Punct}]+"
    forms = entries.filter(F.col("fake_forms").isNotNull()).select(*by, F.explode(F.map_keys("fake_forms")).alias("form")).distinct()
    forms = forms.withColumn("word", F.regexp_extract("form", word, 0)).withColumn("within", (F.col("word") != "") & F.endswith("form", "word"))
    # forms without a word are candidates everywhere
    words = files.select("file_id", *by, F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.coalesce(F.regexp_extract_all(F.col("text"), F.lit(word), F.lit(0)), F.array().cast("array<string>"))))).alias("w"))
    # there are few lengths of first words
    sizes = F.broadcast(forms.select(F.length("word").alias("size"), "within").distinct())
    places = F.transform(F.sequence(F.lit(1), F.length("w") - F.col("size") + 1), lambda i: F.substr(F.col("w"), i, F.col("size")))
    near = words.join(sizes, F.length("w") >= F.col("size")).select("file_id", *by, F.explode(F.when(F.col("within"), places).otherwise(F.array(F.expr("right(w, size)")))).alias("word"), "within").distinct()
    asked = near.join(forms, ["word", "within", *by]).groupBy("file_id", *by).agg(F.collect_set("form").alias("forms"))
    found = files.select("file_id", "text").join(asked, "file_id")
    return found.select("file_id", *by, F.explode(F.filter("forms", lambda f: F.contains(F.col("text"), f))).alias("form"))


def map_scores(files: DataFrame, entries: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """(file_id, map_id, score): a map's tokens that the text has, or whose fake form it contains.

    ``files`` (file_id, text), ``entries`` (map_id, token, canonical_text, fake_forms); tokens meet by equi-join.
    ``by`` names columns, such as a case, that files and maps share; the first tokens are in almost
    every map, so a large store should always have one.
    """
    tokens = files.select("file_id", *by, F.explode(F.array_distinct(M.tokens_in(F.col("text")))).alias("token"))
    by_token = tokens.join(entries.select("map_id", "token", *by).distinct(), ["token", *by]).select("file_id", "map_id", "token")
    forms = entries.filter(F.col("fake_forms").isNotNull()).select("map_id", "token", *by, F.explode(F.map_keys("fake_forms")).alias("form"))
    by_form = forms_in(files, entries, by=by).join(forms, ["form", *by]).select("file_id", "map_id", "token")
    return by_token.unionByName(by_form).distinct().groupBy("file_id", "map_id").agg(F.count("*").alias("score"))


def choose_maps(files: DataFrame, maps: DataFrame, entries: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per file: choice (found, ambiguous, none), map_ids in order of recency (the first one if found).

    ``files`` (file_id, file_name, text); ``maps`` (map_id, recency_rank, source_name, output_name, map_file_name), smaller
    ranks first.  Only maps with a score count; the closest name wins, else the best score; maps that would
    restore the text alike are one.
    """
    scored = map_scores(files, entries, by=by).join(maps.drop(*by), "map_id").join(files.select("file_id", "file_name"), "file_id")
    scored = scored.withColumn("strength", N.link_strength(F.col("file_name"), [F.col("output_name"), F.col("source_name"), F.col("map_file_name")]))
    by_file = Window.partitionBy("file_id")
    strongest = F.max("strength").over(by_file)
    tied = scored.withColumn("top", F.when(strongest > 0, F.col("strength") == strongest).otherwise(F.col("score") == F.max("score").over(by_file))).filter("top")
    tokens = files.select("file_id", "text", M.tokens_in(F.col("text")).alias("tokens"))
    present = tied.select("file_id", "map_id").join(tokens, "file_id").join(entries.drop(*by), "map_id")
    restores = present.select("file_id", "map_id", F.explode(F.concat(
        F.when(F.array_contains("tokens", F.col("token")), F.array(F.struct(F.col("token").alias("k"), F.col("canonical_text").alias("v")))).otherwise(F.array().cast("array<struct<k:string,v:string>>")),
        F.coalesce(F.transform(F.filter(F.map_entries("fake_forms"), lambda e: F.contains(F.col("text"), e["key"])), lambda e: F.struct(F.concat(F.lit("~"), e["key"]).alias("k"), e["value"].alias("v"))), F.array().cast("array<struct<k:string,v:string>>")),
    )).alias("r"))
    key = restores.groupBy("file_id", "map_id").agg(F.to_json(F.array_sort(F.collect_set("r"))).alias("key"))
    kept = tied.join(key, ["file_id", "map_id"]).groupBy("file_id", "key").agg(F.min_by("map_id", "recency_rank").alias("map_id"), F.min("recency_rank").alias("rank"))
    per = kept.groupBy("file_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("rank", "map_id"))).alias("m"))
    choice = per.select("file_id", F.when(F.col("n") == 1, "found").otherwise("ambiguous").alias("choice"), F.transform("m", lambda x: x["map_id"]).alias("map_ids"))
    return files.select("file_id").join(choice, "file_id", "left").select("file_id", F.coalesce("choice", F.lit("none")).alias("choice"), F.coalesce("map_ids", F.array().cast("array<bigint>")).alias("map_ids"))


def decide_maps(files: DataFrame, maps: DataFrame, entries: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per file: what ``choose_maps`` chooses, with map_id instead of map_ids; null unless found.

    No file meets every map: files with the same tokens and forms are one kind, and so are maps with the same
    tokens and forms; kinds are scored against each other.  Of the maps of a kind, in all or under one linked name,
    the least and greatest value of each token tell whether they restore it alike, however many they are.
    """
    scratch = Scratch(files.sparkSession, "maps")
    kind = lambda column: F.sha2(F.to_json(F.struct(*by, column)), 256)
    form = lambda column: F.concat(F.lit("~"), column)
    no_forms = F.array().cast("array<string>")
    # files: what each has of tokens and forms
    marks = files.select("file_id", *by, F.explode(M.tokens_in(F.col("text"))).alias("mark"))
    marks = marks.unionByName(forms_in(files, entries, by=by).select("file_id", *by, form(F.col("form")).alias("mark")))
    marks = marks.groupBy("file_id", *by).agg(F.array_sort(F.collect_set("mark")).alias("marks")).withColumn("f", kind(F.col("marks")))
    named = scratch.keep(marks.join(files.select("file_id", N.normalized_stem(F.coalesce("file_name", F.lit(""))).alias("stem")), "file_id"), "files")
    marks = named.select("f", *by, "marks").distinct().select("f", *by, F.explode("marks").alias("mark"))
    # maps: their kind, and what each makes of its tokens and forms
    own = entries.join(maps.select("map_id"), "map_id")
    parts = own.select("map_id", *by, "token", F.coalesce(F.array_sort(F.map_keys("fake_forms")), no_forms).alias("forms"))
    kinds = scratch.keep(parts.groupBy("map_id", *by).agg(F.array_sort(F.collect_set(F.struct("token", "forms"))).alias("parts")).withColumn("m", kind(F.col("parts"))), "kinds")
    value = lambda column: F.coalesce(F.concat(F.lit("="), column), F.lit(""))
    pair = lambda mark, column: F.struct(mark.alias("mark"), value(column).alias("value"))
    pairs = F.concat(F.array(pair(F.col("token"), F.col("canonical_text"))), F.coalesce(F.transform(F.map_entries("fake_forms"), lambda e: pair(form(e["key"]), e["value"])), F.array().cast("array<struct<mark:string,value:string>>")))
    values = own.select("map_id", *by, F.explode(pairs).alias("p")).groupBy("map_id", *by, F.col("p.mark").alias("mark")).agg(F.to_json(F.array_sort(F.collect_set("p.value"))).alias("value"))
    linked = [N.normalized_stem(F.coalesce(c, F.lit(""))) for c in ("output_name", "source_name", "map_file_name")]
    names = F.array_distinct(F.concat(F.array(F.lit("")), F.filter(F.array(*linked), lambda n: F.length(n) >= 3)))
    rank = F.struct(F.col("recency_rank").isNull().alias("unknown"), F.col("recency_rank").alias("rank"), F.col("map_id").alias("map_id"))
    members = kinds.select("map_id", *by, "m").join(maps.select("map_id", F.explode(names).alias("name"), rank.alias("rank")), "map_id")
    groups = scratch.keep(members.groupBy("m", *by, "name").agg(F.min("rank").alias("first")), "groups")
    spread = scratch.keep(members.join(values, ["map_id", *by]).groupBy("m", "name", "mark").agg(F.min("value").alias("low"), F.max("value").alias("high")), "spread")
    # kinds against kinds
    tokens = kinds.select("m", *by, "parts").distinct().select("m", *by, F.explode("parts").alias("p"))
    tokens = tokens.select("m", *by, F.col("p.token").alias("token"), F.explode(F.concat(F.array("p.token"), F.transform("p.forms", form))).alias("mark"))
    scores = scratch.keep(marks.join(tokens, ["mark", *by]).groupBy("f", "m").agg(F.count_distinct("token").alias("score")), "scores")
    # the closest name of a map with a score: the stem itself, else its longest start before a blank or _
    size, stem = F.length("stem"), F.col("stem")
    starts = F.when(size >= 3, F.filter(F.sequence(F.lit(3), size), lambda i: (i == size) | F.substr(stem, i + 1, F.lit(1)).isin("_", " ")))
    stems = named.select("f", *by, "stem").distinct().select("f", *by, "stem", F.explode(F.transform(starts, lambda i: F.substr(stem, F.lit(1), i))).alias("name"))
    close = stems.join(groups.select("m", *by, "name"), ["name", *by]).join(scores.select("f", "m"), ["f", "m"])
    close = scratch.keep(close.groupBy("f", "stem").agg(F.max_by("name", F.length("name")).alias("name")), "close")
    # the best maps of each kind of file, and under each name
    best = scores.withColumn("best", F.max("score").over(Window.partitionBy("f"))).filter("score = best").select("f", "m", F.lit("").alias("name"))
    under = close.select("f", "name").distinct().join(groups.select("m", "name"), "name").join(scores.select("f", "m"), ["f", "m"])
    tied = scratch.keep(best.unionByName(under.select("f", "m", "name")).join(groups.select("m", "name", "first"), ["m", "name"]), "tied")
    per = tied.groupBy("f", "name").agg(F.count("*").alias("n"), F.min("first").alias("first"))
    seen = tied.select("f", "m", "name").join(spread, ["m", "name"]).join(marks.select("f", "mark"), ["f", "mark"])
    seen = seen.groupBy("f", "name", "mark").agg(F.count("*").alias("held"), F.min("low").alias("low"), F.max("high").alias("high"))
    alike = per.join(seen, ["f", "name"]).groupBy("f", "name", "first").agg(F.bool_and((F.col("held") == F.col("n")) & (F.col("low") == F.col("high"))).alias("alike"))
    chosen = named.select("file_id", "f", "stem").join(close, ["f", "stem"], "left").select("file_id", "f", F.coalesce("name", F.lit("")).alias("name"))
    chosen = scratch.keep(chosen.join(alike, ["f", "name"]).select("file_id", F.when(F.col("alike"), "found").otherwise("ambiguous").alias("choice"), F.when(F.col("alike"), F.col("first.map_id")).alias("map_id")), "chosen")
    scratch.drop("files", "kinds", "groups", "spread", "scores", "close", "tied")
    return files.select("file_id").join(chosen, "file_id", "left").select("file_id", F.coalesce("choice", F.lit("none")).alias("choice"), "map_id")


def expired(maps: DataFrame, now, days: int = 30) -> DataFrame:
    """Maps older than the retention; exactly that old is not yet expired."""
    return maps.filter(F.lit(now).cast("timestamp") - F.col("saved_at") > F.make_dt_interval(F.lit(days)))


def newest_first(maps: DataFrame) -> DataFrame:
    """Remembered maps by the milliseconds at the start of their file name, newest first: a sort by ranges, so of any number of maps."""
    saved = F.regexp_extract("map_file_name", r"^([0-9]+)-", 1).cast("long")
    return maps.withColumn("saved_ms", saved).orderBy(F.col("saved_ms").desc_nulls_last(), "map_file_name")
