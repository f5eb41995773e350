"""Example-based cases for each operator."""

import random

import pytest
from pyspark.sql import functions as F

from veilframe.functions import categories as C
from veilframe.functions import checksums as K
from veilframe.functions import messages as M
from veilframe.functions import names as N
from veilframe.operators import anonymize as A
from veilframe.operators import batch, crypto, filenames, history, maplink, report, restore, review, rules, segments, spans
from veilframe.operators.detect import DETECTORS, detect, detect_native, find, resolve
from veilframe.plans import pipelines as P
from veilframe.sources import files as S
from veilframe.streaming import streams

SPAN = "doc_id long, start int, end int, text string, category string, validation string"


def spans_of(spark, *rows):
    return spans.normalize(spark.createDataFrame([(1, *r) if len(r) == 5 else r for r in rows], SPAN))


def one(df, column):
    return [r[column] for r in df.collect()]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_category_dimension(spark):
    dim = {r["category"]: r for r in C.categories(spark).collect()}
    assert len(dim) == 29 and dim["PERSON"]["prefix"] == "OSOBA" and dim["CUSTOM"]["prefix"] == "DANE"
    assert [r["tone"] for r in dim.values()].count("red") == 14 and [r["tone"] for r in dim.values()].count("purple") == 6
    assert value(spark, C.token_prefix(F.lit("NEW"))) == "DANE" and value(spark, C.category_marker(F.lit("NEW"))) == "*"
    assert value(spark, C.category_class(F.lit("PUBLIC_INSTITUTION"))) == "highlight--public-institution"
    assert spans.category_order(["EMAIL", "PERSON", "NOPE", "EMAIL"]) == ["PERSON", "EMAIL"]


def test_checksums():
    assert K.pesel("44051401359") and not K.pesel("44051401358")
    assert K.nip("526-104-08-28") and not K.nip("5261040827")
    assert K.regon("123456785") and not K.regon("123456784") and K.regon("12345678512347")
    assert K.id_card("ABA300000") and not K.id_card("ABA300001")
    assert K.iban("PL61 1090 1014 0000 0712 1981 2874") and K.iban("61109010140000071219812874") and not K.iban("PL61109010140000071219812875")
    assert K.luhn("4539578763621486") and not K.luhn("4539578763621487")
    assert K.ipv4("10.0.255.1") and not K.ipv4("10.0.256.1")
    assert sum(K.land_register(f"WA4M/00012345/{d}") for d in range(10)) == 1


def test_detects_identifiers(spark):
    text = "Jan Kowalski, PESEL 44051401359, NIP: 526-104-08-28, tel. +48 600 700 800, jan@firma.pl, ul. Polna 5, 12.03.2024, 1 200,50 zł, Sąd Rejonowy w Gdyni, 10.0.0.1, 10.0.0.999"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {(r["category"], r["text"]): r["validation"] for r in detect(docs).collect()}
    for category, found in (("PERSON", "Jan Kowalski"), ("PESEL", "44051401359"), ("NIP", "526-104-08-28"), ("PHONE", "+48 600 700 800"), ("EMAIL", "jan@firma.pl"), ("ADDRESS", "ul. Polna 5"), ("DATE", "12.03.2024"), ("MONEY", "1 200,50 zł"), ("PUBLIC_INSTITUTION", "Sąd Rejonowy w Gdyni"), ("IP_ADDRESS", "10.0.0.1")):
        assert (category, found) in got
    assert got["PESEL", "44051401359"] == "passed" and ("IP_ADDRESS", "10.0.0.999") not in got
    assert all(text[r["start"] : r["end"]] == r["text"] for r in detect(docs).collect())
    assert "DATE" not in one(detect(docs, profile="judgment"), "category")


def test_overlaps_longest_then_category():
    assert [s[3] for s in resolve([(0, 5, "aaaaa", "DATE", ""), (3, 12, "b", "MONEY", ""), (11, 13, "c", "EMAIL", "")])] == ["MONEY"]
    kept = resolve([(0, 4, "x", "EMAIL", ""), (0, 4, "x", "PERSON", "")])
    assert kept[0][3] == "PERSON" and kept[0][5] == ["EMAIL"]
    rng = random.Random(5)
    for _ in range(50):
        found = [(a, a + rng.randint(1, 9), "", rng.choice(list(DETECTORS)), "") for a in rng.sample(range(40), 8)]
        kept = resolve(found)
        assert all(x[1] <= y[0] for x, y in zip(kept, kept[1:]))
        assert all(any(s[0] < k[1] and k[0] < s[1] for k in kept) for s in found)


def test_native_detection_agrees(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    columns = ["doc_id", "start", "end", "text", "category"]
    ours, native = detect(docs, categories=["PHONE"], resolved=False).select(*columns), detect_native(docs, DETECTORS["PHONE"][0], "PHONE").select(*columns)
    assert ours.count() == native.count() > 0 and ours.exceptAll(native).count() == 0


def test_normalize_document_slice_wins(spark):
    docs = spark.createDataFrame([(1, "Anna Nowak")], "doc_id long, text string")
    got = spans.normalize(spark.createDataFrame([(1, 0, 4, "wrong", "PERSON", "passed"), (1, 90, 95, "kept", "PERSON", "passed")], SPAN), docs).orderBy("start").collect()
    assert got[0]["text"] == "Anna" and got[1]["text"] == "kept"
    assert got[0]["id"] == "0-4-PERSON-0" and got[0]["entity_group_id"] == "value:PERSON:Anna" and got[0]["source"] == "regex" and got[0]["status"] == "accepted"


def test_group_numbering(spark):
    rows = spans_of(spark, (30, 34, "Anna", "PERSON", "passed"), (0, 3, "Jan", "PERSON", "passed"), (40, 43, "Jan", "PERSON", "failed"))
    got = {r["label"]: r for r in spans.numbered_groups(spans.entity_groups(rows)).collect()}
    assert got["Jan"]["token"] == "[OSOBA_1]" and got["Anna"]["token"] == "[OSOBA_2]" and got["Jan"]["n"] == 2
    assert one(spans.uncertain_groups(rows), "entity_group_id") == ["value:PERSON:Jan"]
    tie = spark.createDataFrame([(1, "g1", "PERSON", "B", 1, 1, 0, "x", 5, 0), (1, "g2", "PERSON", "A", 1, 1, 0, "y", 5, 1)], "doc_id long, entity_group_id string, category string, label string, n long, n_accepted long, n_rejected long, first_id string, first_start int, first_idx int")
    assert {r["label"]: r["number"] for r in spans.numbered_groups(tie).collect()} == {"A": 1, "B": 2}


def test_exclusion_and_both_kinds_of_accepted(spark):
    rows = spans_of(spark, (0, 3, "Jan", "PERSON", "passed"), (5, 9, "2024", "DATE", "passed"))
    got = spans.reject_excluded(rows, ["DATE"])
    assert {r["category"]: r["status"] for r in got.collect()} == {"PERSON": "accepted", "DATE": "rejected"} and rows.filter("status = 'rejected'").count() == 0
    odd = spark.createDataFrame([("Rejected",), (None,), ("accepted",), ("other",)], "status string")
    assert spans.accepted(odd).count() == 1 and spans.accepted_leniently(odd).count() == 3


def test_anonymize_and_back(spark):
    text = "Jan i Anna i Jan."
    docs = spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "doc_id long, text string")
    out = P.from_spans(docs, spans_of(spark, (0, 3, "Jan", "PERSON", "passed"), (6, 10, "Anna", "PERSON", "passed"), (13, 16, "Jan", "PERSON", "passed")))
    texts = {r["doc_id"]: r["anonymized_text"] for r in out.texts.collect()}
    assert texts == {1: "[OSOBA_1] i [OSOBA_2] i [OSOBA_1].", 2: "nothing", 3: None}
    for r in out.offsets.collect():
        assert texts[1][r["anonymized_start"] : r["anonymized_end"]] == r["token"] and text[r["original_start"] : r["original_end"]] in ("Jan", "Anna")
    back = {r["doc_id"]: r for r in restore.deanonymize(out.texts, out.maps).collect()}
    assert back[1]["original_text"] == text and back[1]["warnings"] == [] and back[2]["original_text"] == "nothing"
    assert not any(one(A.leaks(out.texts, out.entries), "leaks"))
    assert P.clipboard_outcome(docs, out).filter("doc_id = 3").first()["outcome"] == "empty"


def test_rejected_text_stays_and_manual_span_gets_a_token(spark):
    docs = spark.createDataFrame([(1, "Jan ma kod XY-7.")], "doc_id long, text string")
    rows = review.set_category_status(spans_of(spark, (0, 3, "Jan", "PERSON", "passed")), "PERSON", "rejected")
    ranges = spark.createDataFrame([(1, 11, 15, "CUSTOM", None)], "doc_id long, start int, end int, category string, group string")
    out = P.from_spans(docs, review.add_manual(rows, docs, ranges))
    assert out.texts.first()["anonymized_text"] == "Jan ma kod [DANE_1]."
    assert report.count_report(out.spans).first().asDict() == {"doc_id": 1, "detected": 1, "rejected": 1, "manual": 1}


def test_restore_is_single_pass_and_warns(spark):
    texts = spark.createDataFrame([(1, "A [OSOBA_1] b [OSOBA_9]")], "doc_id long, anonymized_text string")
    maps = spark.createDataFrame([(1, [("[OSOBA_1]", "[OSOBA_9]")])], "doc_id long, entries array<struct<token:string,canonical_text:string>>")
    got = restore.deanonymize(texts, maps).first()
    assert got["original_text"] == "A [OSOBA_9] b [OSOBA_9]" and got["warnings"] == ["Unknown anonymization token [OSOBA_9] at offset 14."]
    entries = maps.select("doc_id", F.explode("entries").alias("e")).select("doc_id", "e.*")
    assert [(r["type"], r["text"]) for r in restore.restored_segments(texts, entries).orderBy("pos").collect()] == [("text", "A "), ("restored", "[OSOBA_9]"), ("text", " b "), ("text", "[OSOBA_9]")]


def test_unrestorable_tokens(spark):
    text = F.lit("[OSOBA_1] [OSOBA_7] [OSOBA 1] [Osoba_1] [OSOBA-1] [art. 5] [PKT 3a] [Firma_2]")
    assert set(value(spark, M.unrestorable(text, F.array(F.lit("[OSOBA_1]"))))) == {"[OSOBA_7]", "[OSOBA 1]", "[OSOBA-1]", "[Osoba_1]"}
    assert value(spark, M.warned_tokens(F.array(F.lit("Unknown anonymization token [OSOBA_7] at offset 5."), F.lit("other")))) == ["[OSOBA_7]"]
    assert value(spark, M.token_warning(F.array().cast("array<string>"))) is None
    assert "and 2 more" in value(spark, M.token_warning(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda x: x.cast("string"))))


def test_messages(spark):
    assert value(spark, M.parse_warnings(F.lit("%5B%22a+b%22%2C1%2C%22c%22%5D"))) == ["a+b", "c"]
    assert value(spark, M.parse_warnings(F.lit("%zz"))) == [] and value(spark, M.parse_warnings(F.lit(None).cast("string"))) == []
    assert value(spark, M.split_codes(F.lit("a,,b"))) == ["a", "b"] and value(spark, M.split_codes(F.lit(None).cast("string"))) == []
    assert value(spark, M.metadata_labels(F.array(F.lit("xmp"), F.lit("pdf_xmp"), F.lit("new")))) == ["XMP metadata", "new"]
    assert value(spark, M.picture_notice(F.array(F.lit("faces_masked:3"), F.lit("unknown")))) == "Faces painted over: 3."
    assert value(spark, M.picture_notice(F.array(F.lit("unknown")))) is None
    assert value(spark, M.unread_pages(F.sequence(F.lit(1), F.lit(12)))).endswith("9, 10 and 2 more")
    assert value(spark, M.render_prompt(F.lit("{{DOKUMENT}}-{{DOKUMENT}}"), F.lit("$1"))) == "$1-$1"
    assert [value(spark, M.plural_form(F.lit(n))) for n in (1, 2, 5, 12, 22)] == ["one", "few", "many", "many", "few"]
    assert [value(spark, M.export_fallback(F.lit(n))) for n in (400, 401, 422, 503)] == [True, False, True, True]
    assert value(spark, M.error_message(F.lit(413))) == "file too large" and value(spark, M.next_status(F.lit(0))) == "accepted"


def candidate(spark, rows):
    maps = spark.createDataFrame([(i, i, *names) for i, (names, _) in enumerate(rows)], "map_id long, recency_rank long, source_name string, output_name string, map_file_name string")
    entries = spark.createDataFrame([(i, *e) for i, (_, es) in enumerate(rows) for e in es], "map_id long, token string, category string, canonical_text string, fake_forms map<string,string>")
    return maps, entries


def choose(spark, file_name, text, rows):
    files = spark.createDataFrame([(1, file_name, text)], "file_id long, file_name string, text string")
    got = maplink.choose_maps(files, *candidate(spark, rows)).first()
    return got["choice"], got["map_ids"]


NONE = (None, None, None)


def test_choose_map(spark):
    jan, anna = ("[OSOBA_1]", "PERSON", "Jan", None), ("[OSOBA_1]", "PERSON", "Anna", None)
    assert choose(spark, "x.txt", "[OSOBA_1]", [(NONE, [jan]), (NONE, [anna])]) == ("ambiguous", [0, 1])
    assert choose(spark, "umowa_anon_v2.txt", "[OSOBA_1]", [(NONE, [jan]), (("umowa.txt", None, None), [anna])]) == ("found", [1])
    assert choose(spark, "x.txt", "[OSOBA_1] [NIP_1]", [(NONE, [jan]), (NONE, [anna, ("[NIP_1]", "NIP", "1", None)])]) == ("found", [1])
    assert choose(spark, "x.txt", "[OSOBA_1]", [(NONE, [jan, ("[NIP_1]", "NIP", "1", None)]), (NONE, [jan])]) == ("found", [0])
    assert choose(spark, "umowazlecenie.txt", "[OSOBA_1]", [(("umowa.txt", None, None), [jan]), (NONE, [anna])])[0] == "ambiguous"
    assert choose(spark, "x.txt", "no token", [(NONE, [jan])]) == ("none", [])
    fake = lambda v: ("[OSOBA_1]", "PERSON", v, {"Ewa Lis": v})
    assert choose(spark, "x.txt", "Z Ewa Lis.", [(NONE, [fake("Jan")])]) == ("found", [0])
    assert choose(spark, "x.txt", "Z Ewa Lis.", [(NONE, [fake("Jan")]), (NONE, [fake("Anna")])])[0] == "ambiguous"


def test_decide_maps_as_choose_maps(spark):
    """Kinds of files and maps decide as every file against every map does, with names, forms and cases."""
    rng = random.Random(7)
    text = lambda: " ".join(rng.choice(("[A_1]", "[A_1]", "[A_2]", "[B_1]", "word", "Ewa Lis,", "Janek", "Ewa", "(--)")) for _ in range(rng.randrange(5)))
    name = lambda: rng.choice(("ab.txt", "deed.txt", "deed old.txt", "Deed_anon_v2 (3).txt", "deed old_1.docx", "other.md", None))
    files = [(k, rng.choice("xyz") if k % 9 else None, name(), text() if k % 11 else None) for k in range(150)]
    maps = [(k, k // 2 if k % 5 else None, name(), name(), name()) for k in range(60)]
    entries = []
    for k in range(60):
        case = rng.choice("xyz") if k % 9 else None
        for token in rng.sample(("[A_1]", "[A_2]", "[B_1]", "[C_1]"), rng.randrange(4)):
            forms = {rng.choice(("Ewa Lis", "Jan", "--")): rng.choice("pq")} if rng.random() < 0.3 else None
            entries.append((k, case, token, "PERSON", rng.choice(("p", "p", "p", "q", None)), forms))
    files = spark.createDataFrame(files, "file_id long, case string, file_name string, text string")
    maps = spark.createDataFrame(maps, "map_id long, recency_rank long, source_name string, output_name string, map_file_name string")
    entries = spark.createDataFrame(entries, "map_id long, case string, token string, category string, canonical_text string, fake_forms map<string,string>")
    for by in (("case",), ()):
        f, e = (files, entries) if by else (files.drop("case"), entries.drop("case"))
        ranked = maps.withColumn("recency_rank", F.coalesce(F.col("recency_rank"), F.lit(99)) * 100 + F.col("map_id"))
        plain = {r["file_id"]: (r["choice"], r["map_ids"][0] if r["choice"] == "found" else None) for r in maplink.choose_maps(f, ranked, e, by=by).collect()}
        got = {r["file_id"]: (r["choice"], r["map_id"]) for r in maplink.decide_maps(f, maps, e, by=by).collect()}
        assert got == plain and len({c for c, _ in got.values()}) == 3
        outcome = {r["file_id"]: r["outcome"] for r in P.restore_files(f, maps, e, by=by).collect()}
        assert outcome == {k: {"none": "no_map", "ambiguous": "ambiguous_map", "found": "ok"}[c] for k, (c, _) in got.items()}


def test_restoring_moves_no_text_without_a_map(spark):
    """Many files and maps with one token: the plan that restores is short, and no step grows with their product."""
    files = spark.range(3000).select(F.col("id").alias("file_id"), F.lit("answer.txt").alias("file_name"), F.lit("[A_1] was here").alias("text"))
    maps = spark.range(3000).select(F.col("id").alias("map_id"), F.col("id").alias("recency_rank"), *[F.lit(None).cast("string").alias(c) for c in ("source_name", "output_name", "map_file_name")])
    entries = spark.range(3000).select(F.col("id").alias("map_id"), F.lit("[A_1]").alias("token"), F.lit("PERSON").alias("category"), F.lit("Jan").alias("canonical_text"), F.lit(None).cast("map<string,string>").alias("fake_forms"))
    out = P.restore_files(files, maps, entries)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") < 20
    assert out.groupBy("outcome", "restored_text").count().collect() == [("ok", "Jan was here", 3000)]


def test_parse_maps(spark):
    good = '{"entries":[{"token":"[A_1]","canonical_text":"x","category":"PERSON"}]}'
    rows = spark.createDataFrame([(0, good), (1, '{"map":%s}' % good), (2, "{}"), (3, "[]"), (4, "no"), (5, '{"entries":[{"token":1,"canonical_text":"x","category":"P"}]}'), (6, '{"entries":[]}')], "k int, json string")
    strict = {r["k"]: r["entries"] for r in maplink.parse_maps(rows).collect()}
    assert strict[0][0]["token"] == "[A_1]" and strict[1] == strict[0] and strict[6] == [] and all(strict[k] is None for k in (2, 3, 4, 5))
    assert maplink.parse_maps(rows, strict=False).filter("k = 5").first()["entries"] is not None


def test_stems_and_links(spark):
    for name, stem in (("Umowa_anon_restored (2).docx", "umowa"), ("a/b\\umowa_anon_map.json", "umowa"), ("umowa_anon.docx", "umowa")):
        assert value(spark, N.normalized_stem(F.lit(name))) == stem
    strength = lambda f, n: value(spark, N.link_strength(F.lit(f), [F.lit(n)]))
    assert strength("umowa.txt", "umowa.docx") == 1_000_005 and strength("umowa x.txt", "umowa.docx") == 5 and strength("umowax.txt", "umowa.docx") == 0 and strength("ab.txt", "ab.txt") == 0


def test_blocks(spark):
    docs = spark.createDataFrame([(1, "a\n\nb\n\n\nc\fd"), (2, "x" * 12000), (3, ""), (4, None)], "doc_id long, text string")
    blocks = segments.split_blocks(docs).orderBy("doc_id", "idx").collect()
    assert [(b["text"], b["page"]) for b in blocks if b["doc_id"] == 1] == [("a\n\n", 1), ("b\n\n\n", 1), ("c\f", 1), ("d", 2)]
    assert [b["end"] - b["start"] for b in blocks if b["doc_id"] == 2] == [5000, 5000, 2000] and {b["doc_id"] for b in blocks} == {1, 2}
    assert segments.paginate(segments.split_blocks(docs)).filter("doc_id = 2").first()["pages"] == 1
    assert segments.page_of(segments.split_blocks(docs), 9).filter("doc_id = 2").count() == 3


def test_span_across_blocks_is_clipped(spark):
    docs = spark.createDataFrame([(1, "ab\n\ncd")], "doc_id long, text string")
    rows = spans_of(spark, (1, 5, "b\n\nc", "PERSON", "passed"))
    got = segments.segment_blocks(segments.split_blocks(docs), rows).orderBy("idx", "pos").collect()
    assert [(r["idx"], r["type"], r["start"], r["end"], r["text"]) for r in got] == [(0, "text", 0, 1, "a"), (0, "entity", 1, 4, "b\n\n"), (1, "entity", 4, 5, "c"), (1, "text", 5, 6, "d")]


def test_comparison_segments(spark):
    texts = spark.createDataFrame([(1, "Jan Nowak x")], "doc_id long, text string")
    offsets = spark.createDataFrame([(1, 0, 4, 0, 9, "[A_1]", "PERSON"), (1, 2, 6, 0, 9, "[B_1]", "PERSON"), (1, 4, 9, 9, 18, "[C_1]", "PERSON"), (1, 10, 99, 0, 0, "[D_1]", "PERSON"), (1, 50, 60, 0, 0, "[E_1]", "PERSON")], "doc_id long, original_start int, original_end int, anonymized_start int, anonymized_end int, token string, category string")
    got = segments.comparison_segments(texts, offsets, "original").orderBy("pos").collect()
    assert [(r["type"], r["text"], r["id"]) for r in got] == [("replacement", "Jan ", "[A_1]"), ("replacement", "Nowak", "[C_1]"), ("text", " ", None), ("replacement", "x", "[D_1]")]
    assert value(spark, segments.selection_range(F.lit(7), F.lit(3))) == (3, 7) and value(spark, segments.selection_range(F.lit(3), F.lit(3))) is None


def test_case_numbering_and_seed(spark):
    rows = spans_of(spark, (2, 0, 3, "Jan", "PERSON", "x"), (1, 5, 9, "Anna", "PERSON", "x"), (1, 20, 23, "Jan", "PERSON", "x")).withColumn("case", F.lit("k"))
    got = {r["label"]: r["token"] for r in spans.case_numbering(rows, case_col="case").collect()}
    assert got == {"Anna": "[OSOBA_1]", "Jan": "[OSOBA_2]"}
    seed = spark.createDataFrame([("k", "[OSOBA_4]", "PERSON", "Jan")], "case string, token string, category string, canonical_text string")
    got = {r["label"]: r["token"] for r in spans.case_numbering(rows, case_col="case", seed=seed).collect()}
    assert got == {"Anna": "[OSOBA_5]", "Jan": "[OSOBA_4]"}
    docs = spark.createDataFrame([(1, "xxxx Anna" + " " * 11 + "Jan", "k"), (2, "Jan", "k")], "doc_id long, text string, case string")
    out = P.anonymize_case(docs, rows.drop("case"), case_col="case", seed=seed)
    assert {r["doc_id"]: r["anonymized_text"] for r in out.texts.collect()}[2] == "[OSOBA_4]"


def test_review_edits(spark):
    rows = spans_of(spark, (0, 3, "Jan", "PERSON", "x"), (5, 9, "Anna", "PERSON", "x"), (12, 15, "ABC", "COMPANY", "x"))
    state = lambda df: {r["text"]: r for r in df.collect()}
    jan, anna = state(rows)["Jan"]["id"], state(rows)["Anna"]["id"]
    got = state(review.replay(rows, [("entity_category", jan, "CUSTOM"), ("merge", "value:PERSON:Anna", "value:COMPANY:ABC"), ("entity_status", jan, "rejected")]))
    assert got["Jan"]["entity_group_id"] == "value:CUSTOM:Jan" and got["Jan"]["status"] == "rejected"
    assert got["Anna"]["category"] == "COMPANY" and got["Anna"]["canonical_text"] == "ABC"
    assert state(review.replay(rows, [("merge", "value:PERSON:Anna", "value:PERSON:Anna"), ("merge", "value:PERSON:Jan", "nope"), ("assign", anna, "nope")])) == state(rows)
    got = state(review.replay(rows, [("assign", anna, "value:PERSON:Jan"), ("new_group", jan), ("group_status", "value:COMPANY:ABC", "rejected")]))
    assert got["Anna"]["canonical_text"] == "Jan" and got["Jan"]["entity_group_id"] == f"manual-group-{jan}" and got["ABC"]["status"] == "rejected"
    with pytest.raises(ValueError):
        review.replay(rows, [("nope",)])


def test_file_names(spark):
    entry = lambda t, c, v, *more: {"token": t, "category": c, "canonical_text": v, "variants": list(more)}
    person = [entry("[OSOBA_1]", "PERSON", "Jan Kowalski")]
    assert filenames.rename("Umowa Kowalskiego", person) == "Umowa [OSOBA_1]"
    assert filenames.rename("umowa_jan-kowalski_2024", person) == "umowa_[OSOBA_1]_2024"
    assert filenames.rename("Janina Kowalewska", person) == "Janina Kowalewska"
    assert filenames.rename("ACME", [entry("[FIRMA_1]", "COMPANY", "ACME"), entry("[X_1]", "CUSTOM", "FIRMA")]) == "[FIRMA_1]"
    assert filenames.rename("x", None) == "x"
    assert [value(spark, N.safe_base_name(F.lit(n))) for n in ("a:b?.docx", ".txt", "  x   y .md")] == ["a_b_", "dokument", "x y"]
    rows = spark.createDataFrame([(0, "f", "a"), (1, "f", "a"), (2, "f", "a-2")], "idx int, folder string, base string")
    assert [(r["unique_name"], r["name_collision"]) for r in filenames.unique_names(rows, by=["folder"]).orderBy("idx").collect()] == [("a", False), ("a-2", True), ("a-2", True)]
    wanted = spark.createDataFrame([("d", "r.txt"), ("d", "s.txt")], "folder string, name string")
    existing = spark.createDataFrame([("d", "r.txt"), ("d", "r (2).txt"), ("d", "r (4).txt"), ("e", "s.txt")], "folder string, name string")
    assert {r["name"]: r["free_name"] for r in filenames.free_names(wanted, existing).collect()} == {"r.txt": "r (3).txt", "s.txt": "s.txt"}


def test_extensions(spark):
    assert value(spark, N.mime_of(F.lit("A.PDF"))) == "application/pdf" and value(spark, N.mime_of(F.lit("a"))) == "application/octet-stream"
    applies = lambda a, *p: value(spark, N.action_applies(F.lit(a), F.array(*[F.lit(x) for x in p]).cast("array<string>")))
    assert applies("restore", "a.txt", "b.MD") and not applies("restore", "a.txt", "b.png") and not applies("ocr", "a.txt") and not applies("ocr") and not applies("nope", "a.txt") and not applies("metadata", "noext")


def test_rules(spark):
    assert rules.problem("n", "[0-9]+", "l", 25).startswith("No more") and "name" in rules.problem(" ", "", "", 0) and "label" in rules.problem("n", "", " ", 0) and "pattern" in rules.problem("n", " ", "l", 0)
    assert "256" in rules.problem("n", "x" * 257, "l", 0) and "valid" in rules.problem("n", "(", "l", 0) and rules.problem("n", "a*", "l", 0) is None
    assert value(spark, rules.preview(F.lit("b" * 3 + "ab" * 30), "a*")) == ["a"] * 20
    loaded = rules.load(spark.createDataFrame([('[{"id":"1","name":"a","pattern":"x","label":"L"},{"id":"2"}]',), ("bad",)], "json string"))
    assert one(rules.enabled(loaded), "name") == ["a"]
    assert find("ab12", [("CUSTOM", __import__("re").compile("[0-9]*"), None, True)]) == [(2, 4, "12", "CUSTOM", "not_applicable")]


def test_report(spark):
    offsets = spark.createDataFrame([(1, 0, "x", "PERSON", "[A_1]"), (1, 9, "y", "COMPANY", "[A_1]"), (1, 4, "[B_1]", "DATE", None)], "doc_id long, original_start int, token string, category string, label string")
    got = {r["token"]: (r["category"], r["occurrences"], r["pos"]) for r in report.token_report(offsets).collect()}
    assert got == {"[A_1]": ("COMPANY", 2, 0), "[B_1]": ("DATE", 1, 4)}
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    full = report.report(docs, offsets, spans_of(spark, (0, 1, "a", "PERSON", "x"))).first()
    assert [t["token"] for t in full["tokens"]] == ["[A_1]", "[B_1]"] and full["app_version"] == "unknown"
    assert full["source_sha256"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_history(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Jan"), (2, "x")], "doc_id long, text string")
    out = P.from_spans(docs, spans_of(spark, (0, 3, "Jan", "PERSON", "x")))
    rows = history.sessions(docs, out.spans, out.maps, F.lit("2024-01-01 10:00:00.900").cast("timestamp") - F.make_dt_interval(mins=F.lit(0), secs=F.col("doc_id").cast("decimal(18,6)") / 10))
    assert history.save(rows, str(tmp_path / "h"), enabled=False) is None
    history.save(rows, str(tmp_path / "h"))
    stored = history.load(spark, str(tmp_path / "h"))
    assert one(history.listing(stored), "id") == [2, 1] and history.latest(stored).first()["id"] == 2
    assert history.get(stored, 1, "entries array<struct<token:string>>").first()["session"]["entries"][0]["token"] == "[OSOBA_1]" and history.get(stored, 9, "x int").count() == 0
    assert history.delete(stored, 1).count() == 1 and history.delete(stored).count() == 0 and history.usage(stored).first()["requests"] == 2


def test_batch(spark):
    items = spark.createDataFrame([(0, "ok", "queued"), (1, "bad", "queued"), (2, "again", "error"), (3, "old", "done")], "idx int, text string, status string")

    def work(text):
        if text == "bad":
            raise ValueError("broken")
        return text.upper()

    got = {r["idx"]: (r["status"], r["result"], r["error"]) for r in batch.process(items, work).collect()}
    assert got == {0: ("done", "OK", None), 1: ("error", None, "broken"), 2: ("done", "AGAIN", None), 3: ("done", None, None)}
    assert batch.progress(items).first().asDict() == {"complete": 1, "failed": 1, "total": 4}


def test_maps_under_password(spark):
    rows = spark.createDataFrame([("{}",), ('{"a":"ż"}',)], "json string")
    sealed = crypto.encrypt_maps(rows, "hasło", iterations=crypto.LEAST)
    back = crypto.decrypt_maps(sealed, "hasło").collect()
    assert all(r["json"] == r["decrypted"] for r in back) and crypto.decrypt_maps(sealed, "wrong").filter("decrypted IS NOT NULL").count() == 0
    odd = spark.createDataFrame([("no json",), ('{"format":"map-encrypted","kdf":"PBKDF2-SHA256","iterations":9,"salt":"AA==","iv":"AA==","ciphertext":"AA=="}',)], "encrypted string")
    assert one(crypto.decrypt_maps(odd, "x"), "decrypted") == [None, None] and one(odd.select(crypto.is_encrypted(F.col("encrypted")).alias("e")), "e") == [False, True]


def test_map_store(spark, tmp_path):
    maps = spark.createDataFrame([(1, None, "a.txt", 5), (2, 3, None, None)], "file_id long, saved_at long, source_name string, idx int").withColumn("map_id", F.col("file_id"))
    both = maplink.candidates(maps.filter("map_id = 1").drop("saved_at"), maps.filter("map_id = 2").withColumn("file_id", F.lit(1).cast("long")).drop("idx"))
    assert one(both.orderBy("recency_rank"), "map_id") == [1, 2]
    old = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:01")], "k int, s string").withColumn("saved_at", F.col("s").cast("timestamp"))
    assert one(maplink.expired(old, F.lit("2024-01-31 00:00:01").cast("timestamp")), "k") == [1]
    names = spark.createDataFrame([("5-aa.json",), ("40-bb.json",)], "map_file_name string")
    assert one(maplink.newest_first(names), "map_file_name") == ["40-bb.json", "5-aa.json"]
    store = spark.createDataFrame([("2024-01-01 00:00:00", "a", "b", [("[A_1]",)])], "saved_at string, source_name string, output_name string, entries array<struct<token:string>>").withColumn("saved_at", F.col("saved_at").cast("timestamp"))
    assert S.remember_map(store, str(tmp_path / "m"), b"0123456789abcdef", enabled=False) is None
    kept = S.remember_map(store, str(tmp_path / "m"), b"0123456789abcdef").first()
    assert kept["map_file_name"].startswith("1704067200000-") and b"A_1" not in bytes(kept["sealed"])


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in (("b.TXT", "bb"), ("sub/a.txt", "aaa"), ("c.exe", "c"), ("m.json", '{"entries":[]}')):
        (tmp_path / name).write_text(text)
    assert one(S.scan_folder(spark, str(tmp_path)), "name") == ["a.txt", "b.TXT"]
    assert one(S.scan_folder(spark, str(tmp_path), most_bytes=2), "name") == ["b.TXT"]
    assert sorted(one(S.read_texts(spark, str(tmp_path)), "text")) == ["aaa", "bb"] and S.read_maps(spark, str(tmp_path)).count() == 1
    assert one(S.excluded_categories(spark.createDataFrame([('["EMAIL","X","PERSON"]',), ("bad",)], "json string")), "category") == ["PERSON", "EMAIL"]
    assert one(S.nonblank(spark.createDataFrame([(" \n",), ("x",)], "text string")), "text") == ["x"] and len(S.engine_info(spark).first()["categories"]) == 29


def test_streams(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(source)
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.event_windows(streams.read_stream(spark, str(tmp_path / "in"), events.schema))
    assert stream.isStreaming
    docs = spark.createDataFrame([(1, "a@b.pl")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    found = streams.detect_stream(streams.read_stream(spark, str(tmp_path / "docs"), docs.schema), categories=["EMAIL"])
    streams.run_once(found, str(tmp_path / "out"), str(tmp_path / "c"))
    assert one(spark.read.parquet(str(tmp_path / "out")), "text") == ["a@b.pl"]


def test_pseudonyms(spark):
    docs = spark.createDataFrame([(1, "Jan Kot +48 600 700 800")], "doc_id long, text string")
    got = A.pseudonymize(P.anonymize_documents(docs).tokens).orderBy("start").collect()
    assert got[0]["label"] == "[OSOBA_1]" and got[0]["fake_forms"] == {got[0]["token"]: "Jan Kot"} and got[0]["token"] != "Jan Kot"
    assert len(got[1]["token"]) == len("+48 600 700 800")


def test_invariants_on_random_spans(spark):
    """Restoring gives the text back, offsets fit both sides, and segments add up to their texts."""
    rng = random.Random(21)
    texts, rows = [], []
    for doc in range(60):
        text = "".join(rng.choice("ab ż\n😀") for _ in range(rng.randrange(80)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randrange(6))))
        texts.append((doc, text))
        rows += [(doc, a, b, text[a:b], rng.choice(["PERSON", "EMAIL", "DATE", "CUSTOM"]), "passed") for a, b in zip(cuts[::2], cuts[1::2])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    out = P.from_spans(docs, spans.reject_excluded(spans.normalize(spark.createDataFrame(rows, SPAN)), ["DATE"]))
    plain, hidden = dict(texts), {r["doc_id"]: r["anonymized_text"] for r in out.texts.collect()}
    assert {r["doc_id"]: r["original_text"] for r in restore.deanonymize(out.texts, out.maps).collect()} == plain
    values = {(r["doc_id"], r["token"]): r["canonical_text"] for r in out.entries.collect()}
    for r in out.offsets.collect():
        assert hidden[r["doc_id"]][r["anonymized_start"] : r["anonymized_end"]] == r["token"]
        assert plain[r["doc_id"]][r["original_start"] : r["original_end"]] == values[r["doc_id"], r["token"]]
    for segs, whole in (
        (segments.comparison_segments(docs, out.offsets, "original"), plain),
        (segments.comparison_segments(out.texts, out.offsets, "anonymized", text_col="anonymized_text"), hidden),
        (restore.restored_segments(out.texts, out.entries), plain),
    ):
        got = {}
        for r in segs.orderBy("doc_id", "pos").collect():
            assert r["start"] == len(got.get(r["doc_id"], ""))
            got[r["doc_id"]] = got.get(r["doc_id"], "") + r["text"]
        assert got == {k: t for k, t in whole.items() if t}


def test_cues_and_sweep_change_no_span():
    """Detection by cues and the sweep over spans agree with plain scans, and long runs cost little."""
    import random
    import re
    import time

    from veilframe.operators import detect as D

    rng = random.Random(5)
    parts = ["Alfa", "Beta-Gamma", "Sp. z o.o.", "S.A.", "sp.k.", "firma", "x", "a@b.pl", "@", "a.b@c-d.org.pl", "..@x.yy", "q@", "@b.pl", "a@b.com_x@c.de"]
    compiled = {c: re.compile(D.DETECTORS[c][0]) for c in D.CUED}
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice((" ", " ", "", ", ", "\n")) for _ in range(rng.randint(1, 9)))
        for category, pattern in compiled.items():
            assert [m.span() for m in D.CUED[category](text, pattern)] == [m.span() for m in pattern.finditer(text)], text
    for _ in range(300):
        spans = [(a, a + rng.randint(1, 9), "", rng.choice(sorted(D.ORDER)), "") for a in (rng.randrange(60) for _ in range(rng.randint(0, 20)))]
        kept = []
        for s in sorted(spans, key=lambda s: (s[0] - s[1], D.ORDER[s[3]], s[0], s[3])):
            if not any(s[0] < k[1] and k[0] < s[1] for k in kept):
                kept.append(s)
        assert [s[:4] for s in D.resolve(spans)] == [s[:4] for s in sorted(kept)]
    began = time.process_time()
    detectors = [(c, re.compile(p), check, lenient) for c, (p, check, lenient) in D.DETECTORS.items()]
    for run in ("Aa ", "a", "Aa@", "1 "):
        D.find(run * (200_000 // len(run)), detectors)
    assert time.process_time() - began < 30
