"""Operators of the llm subpackage against brute force, round trips and held-out labels."""

import re
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import decontaminate, language, lines, packing, pivots, pseudonyms, quality, simhash, substring, token_files
from tessella.llm.fm_index import FMIndex
from tessella.llm.tokens import encoder, tokenizer_path

DDL = "doc_id long, text string, lang string, source string, n_chars long, id string, tag string, text_b string"
LONG = " ".join(f"w{k}" for k in range(3000))
PASSAGE = " ".join(f"passage{k}" for k in range(20))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns with clashing names."""
    texts = [
        (1, PASSAGE), (2, f"before {PASSAGE} after"), (3, None), (4, ""), (5, LONG), (6, LONG + " end"), (7, "short"), (7, "short"),
        (8, "one\ntwo\nthree\nfour"), (9, "zero\none\ntwo\nthree\n\nfour"), (9, "zero\none\ntwo\nthree\n\nfour"), (None, PASSAGE), (10, "x"), (10, "y"), (11, PASSAGE),
    ]
    return spark.createDataFrame([(i, t, "en", None, None, "a", None, "z") for i, t in texts], DDL)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def words(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def test_fm_index_counts_every_window():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(1, 4, 400), 0)
    text[[50, 200]] = 0
    starts = np.array([s for s in range(len(text) - 5) if (text[s : s + 5] > 0).all()])
    low, high = FMIndex(text, 5).search(starts, 5)
    seen = defaultdict(int)
    for s in starts:
        seen[tuple(text[s : s + 5])] += 1
    assert all(h - a == seen[tuple(text[s : s + 5])] or (h - a == 1 and seen[tuple(text[s : s + 5])] == 1) for s, a, h in zip(starts, low, high, strict=True))


@pytest.mark.parametrize("hot", [1000, 0])
def test_substring_dedup(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT_PIECES", hot)
    rows = [(r.doc_id, words(r.text)) for r in docs.collect()]
    first = {}
    for i, w in rows:
        for k in range(len(w) - 12):
            if i is not None:
                key = tuple(w[k : k + 13])
                first[key] = min(first.get(key, i), i)
    expected = []
    for i, w in rows:
        gone = {k + j for k in range(len(w) - 12) for j in range(13) if i is not None and first[tuple(w[k : k + 13])] < i}
        expected.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = [tuple(r) for r in substring.remove_repeats(docs).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert substring.remove_repeats(empty).count() == 0


def test_line_dedup(docs, empty):
    got = {(r.doc_id, r.text): r for r in lines.remove_repeated_lines(docs).collect()}
    assert got[(9, "zero\n")].n_removed == 4  # one, two, three and the window over the blank line
    assert got[(8, "one\ntwo\nthree\nfour")].n_removed == 0
    kept = lines.without_repeated_lines(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert {r.text for r in kept.where("doc_id = 9").collect()} == {"zero\n"} and kept.where("doc_id = 3").first().text is None
    assert lines.remove_repeated_lines(empty).count() == 0


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, PASSAGE.upper()), (2, "short"), (3, None), (None, "x"), (4, "one two")], "item_id long, text string")
    got = {(r.doc_id, r.n_words): (r.n_hit, r["items"], r.contaminated) for r in decontaminate.decontaminate(docs, items).collect()}
    assert got[(1, 20)] == (20, ["1"], True) and got[(2, 22)] == (20, ["1"], True) and got[(None, 20)] == (20, ["1"], True)
    assert got[(7, 1)] == (1, ["2"], True) and got[(8, 4)] == (2, ["4"], True) and got[(3, 0)] == (0, [], False)
    assert got[(10, 1)] == (0, [], False) and got[(5, 3000)] == (0, [], False)
    assert {r.doc_id for r in decontaminate.clean(docs, items).collect()} == {3, 4, 5, 6, 10}
    assert decontaminate.clean(docs, items.where("false")).count() == docs.count() and decontaminate.decontaminate(empty, items).count() == 0


def brute_print(text):
    w = words((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, linked):
    label = {k: k for k in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if a < b and linked(values[a], values[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_simhash(docs, empty):
    rows = docs.collect()
    got = simhash.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint & (2**64 - 1)) for r in got) == sorted((str(r.doc_id), brute_print(r.text)) for r in rows)
    prints = {r.doc_id: brute_print(r.text) for r in rows if r.doc_id not in (None, 10)}
    expected = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    assert {r.doc_id: r.component_id for r in got if r.doc_id in expected} == expected
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("doc_id IN (7, 9)").count() == 2 and kept.where("doc_id IS NULL").count() == 1
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_keeps_each_text_of_a_repeated_id(docs):
    """The texts of id 10 are not near each other, so both components keep their document."""
    kept = simhash.keep_one(docs).where("doc_id IN (7, 10)").collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(7, "short"), (10, "x"), (10, "y")]


def test_simhash_keeps_rows_with_clashing_names(docs):
    names = {"id": "__text", "tag": "row", "text_b": "crc"}
    assert simhash.keep_one(docs.withColumnsRenamed(names)).count() == simhash.keep_one(docs).count()


def test_simhash_links_are_exact(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63 - 1, 60)
    found = set(base.tolist())
    for value in base.tolist():
        for flips in (1, 2, 3, 4):
            for bit in rng.choice(64, flips, replace=False).tolist():
                value ^= -(1 << 63) if bit == 63 else 1 << bit
            found.add(value)
    prints = dict(enumerate(sorted(found)))
    links = [(r.a, r.b) for r in simhash.link_prints(spark.createDataFrame([(v,) for v in prints.values()], "fp long")).collect()]
    number = {v: k for k, v in prints.items()}
    edges = {(number[a], number[b]) for a, b in links} | {(number[b], number[a]) for a, b in links}
    got = brute_components({k: k for k in prints}, lambda a, b: (a, b) in edges)
    assert got == brute_components(prints, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)


def test_tokens_equal_whole_texts():
    for name, dtype in (("byte_bpe_50k.json", "<u4"), ("word_bpe_49k.json", "<u2")):
        tool = encoder(tokenizer_path(name), dtype)
        texts = ["  a  b   c \n\n x", "don't  it's\t\tx ", "<|endoftext|> a<|endoftext|>b", "x\x1c y \x85 z", "", "\n", "é. ́", "a.b,c!!d ²½. Ⅷ,", "1234 567 .. 'sabc", "　全角 空白"]
        assert tool.encode(texts) == [np.array(tool.tokenizer.encode(t, add_special_tokens=False).ids, dtype).tobytes() for t in texts]


def test_texts_that_are_not_utf8(spark):
    """Bytes that are no UTF-8 crash no operator; the tokenizers read them as U+FFFD."""
    frame = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text UNION ALL SELECT 2L, 'a b'").withColumn("lang", F.lit("en"))
    ids = np.array(encoder(tokenizer_path(packing.TOKENIZER), "<u4").tokenizer.encode("a\ufffdb", add_special_tokens=False).ids + [2], "<u4")
    assert {r.doc_id: r.ids for r in packing.pack(frame).collect()}[1] == ids.tobytes()
    assert token_files.encode_and_read_back(frame).count() == 2 and language.identify(frame, language.learn(frame)).count() == 2
    assert lines.without_repeated_lines(frame).count() == 2 and language.keep_accepted(frame, language.learn(frame)).count() <= 2
    assert simhash.near_duplicates(frame).count() == 2 and substring.remove_repeats(frame).count() == 2 and pseudonyms.pseudonymise(frame, "key").count() == 2


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_with_separator_controls(name):
    tool = encoder(tokenizer_path(name), "<u4")
    for text in ["a!\x1cb", "a!!\x1d!b", "don'\x1ct", "a\x1e b", "\x1f\x1f a", "a \x1c"]:
        assert tool.encode([text]) == [np.array(tool.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()], repr(text)


def test_packing(docs, empty):
    rows = packing.pack(docs, 64).collect()
    tool = encoder(tokenizer_path(packing.TOKENIZER), "<u4")
    pieces = []
    for r in docs.collect():
        ids = tool.encode([r.text or ""])[0] + np.array([2], "<u4").tobytes()
        pieces += [(r.doc_id, k, at, n, crc32(ids[4 * at : 4 * (at + n)])) for k, (at, n) in enumerate(packing.cut_points(len(ids) // 4, 64))]
    assert sorted(map(str, pieces)) == sorted(str(tuple(r)[:5]) for r in rows)
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        ends = 0
        for at, n in sorted(parts):
            assert at == ends
            ends += n
        assert ends <= 64
    assert packing.pack(empty).count() == 0


def test_packing_carries_the_ids(docs):
    """Sequences put together from the output hold the documents' tokens."""
    tool = encoder(tokenizer_path(packing.TOKENIZER), "<u4")
    rows = packing.pack(docs, 64).collect()
    assert all(crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    sequences = {s: b"".join(r.ids for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset)) for s in {r.sequence_id for r in rows}}
    text = b"".join(sequences[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] for r in sorted((r for r in rows if r.doc_id == 5), key=lambda r: r.piece))
    assert text == tool.encode([LONG])[0] + np.array([2], "<u4").tobytes()


def test_packing_is_close_to_the_bound():
    counts = dict(zip(*(x.tolist() for x in np.unique(np.random.default_rng(2).integers(1, 1025, 50_000), return_counts=True)), strict=True))
    plan = packing.plan_sequences(counts)
    used = int((plan[:, 3] + plan[:, 2]).max())
    assert used <= 1.004 * sum(n * c for n, c in counts.items()) / 1024 and plan[:, 2].sum() == 50_000


def test_token_files(docs, empty):
    got = token_files.encode_and_read_back(docs).collect()
    tool = encoder(tokenizer_path(token_files.TOKENIZER), "<u4")
    expected, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, crc32((r.text or "").encode()), r.text or "")):
        ids = tool.encode([r.text or ""])[0] + np.array([1], "<u4").tobytes()
        expected.append((r.doc_id, start, len(ids) // 4, crc32(ids)))
        start += len(ids) // 4
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    assert token_files.encode_and_read_back(empty).count() == 0


@pytest.mark.parametrize("values", [[0], [5, 5, 5], [-(2**63), 0, 2**63 - 1], list(range(0, 90_000, 7)), [0] * 600 + [10**9]])
def test_elias_fano(values):
    series, _ = token_files.EliasFano.from_bytes(b"x" + token_files.EliasFano.encode(np.array(values)).to_bytes(), 1)
    assert series.select(np.arange(len(values))).tolist() == values and series.select([len(values) - 1]).tolist() == values[-1:]


def test_language(spark, docs, empty):
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(source, language.learn(source)).join(source.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in found]) > 0.97
    model = language.learn(source)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert got[3].lang_pred == got[4].lang_pred == "und" and not got[3].accepted and got[None].held_out
    assert language.keep_accepted(docs, model).columns == docs.columns
    assert language.identify(docs, language.learn(empty)).where("lang_pred <> 'und'").count() == 0


def test_quality(spark, docs, empty):
    source, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn(source, labels)
    found = quality.classify(source, model).join(labels.dropDuplicates(["doc_id"]), "doc_id").where("held_out AND quality IS NOT NULL").collect()
    assert np.mean([r.predicted == r.quality for r in found]) > 0.93
    assert all(0 <= r.score <= 1 for r in quality.classify(docs, model).collect())
    assert {r.score for r in quality.classify(docs, quality.learn(empty, labels)).collect()} == {0.5}


def test_factorisation_machine_identity():
    rng = np.random.default_rng(3)
    model = quality.FactorisationMachine(0.3, rng.normal(size=6).astype(np.float32), rng.normal(size=(6, 4)).astype(np.float32))
    x = rng.normal(size=6)
    pairs = sum(model.factors[i] @ model.factors[j] * x[i] * x[j] for i in range(6) for j in range(i))
    assert np.isclose(model.margins(1, np.zeros(6, int), np.arange(6), x)[0], 0.3 + model.weights @ x + pairs, atol=1e-4)


def test_pivots(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 64))
    near = base[:200] / np.linalg.norm(base[:200], axis=1, keepdims=True) + rng.normal(size=(200, 64)) * 0.04
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(base)] + [(1000 + k, v.tolist(), k % 3) for k, v in enumerate(near)]
    rows += [(2000, base[0].tolist(), 0), (2001, None, 0), (2002, [0.0] * 64, 0), (2003, [float("nan")] * 64, 0), (2004, base[1].tolist(), None), (2005, [1.0, 2.0], 0), (2006, [], 0)]
    got = {r.vec_id: r for r in pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    good = [r for r in rows if r[0] < 2001]
    x = np.array([v for _, v, _ in good])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([c for *_, c in good])
    true = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    counts = true.sum(1) - 1
    assert sum(got[r[0]].n_links for r in good) >= 0.9 * counts.sum() and counts.sum() > 200
    assert all(got[r[0]].n_links <= c for r, c in zip(good, counts, strict=True)) and got[2000].component_id == 0 and not got[2000].kept
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in range(2001, 2007))
    assert pivots.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def luhn(number):
    return sum(d if k % 2 == 0 else (2 * d - 9 * (d > 4)) for k, d in enumerate(map(int, reversed(number)))) % 10


def test_pseudonyms(spark, docs):
    values = ["4539578763621486", "4539578763621487", "+1 (017) 555-7713", "97.51.17.173", "2024-02-29", "was.91@mail6.example.com"]
    other = ["999.1.1.1", "2023-02-30", "CC BY-NC 4.0."]
    text = "; ".join(values + other) + "."
    frame = spark.createDataFrame([(1, text), (2, "again 4539578763621486 and\n97.51.17.173"), (3, None), (4, ""), (5, "none")], "doc_id long, text string")
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(frame, "key").collect()}
    parts = got[1].text.rstrip(".").split("; ")
    assert all(a != b for a, b in zip(values, parts, strict=False))
    assert luhn(parts[0]) == 0 and luhn(parts[1]) == luhn(values[1]) and len(parts[0]) == 16
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", parts[2]) and all(int(o) < 256 for o in parts[3].split("."))
    assert np.datetime64(parts[4]) and re.fullmatch(r"[a-z]{3}\.\d\d@mail6\.example\.com", parts[5])
    assert parts[6:8] == other[:2] and parts[8].startswith("CC BY-NC 4.0")
    assert got[2].text == f"again {parts[0]} and\n{parts[3]}" and got[3].text is None and got[4].text == "" and got[5].n_found == 0
    assert pseudonyms.pseudonymise(frame, "other").where("doc_id = 2").first().text != got[2].text
    days = spark.range(73049).selectExpr("id AS doc_id", "cast(date_add(date'1900-01-01', cast(id AS int)) AS string) AS text")
    assert pseudonyms.pseudonymise(days, "key").select("text").distinct().count() == 73049
    assert pseudonyms.pseudonymise(docs, "key").count() == docs.count()


def test_pseudonyms_of_other_layouts(spark):
    phones = ["+14155550123", "+1-415-555-0123", "+1.415.555.0123", "+33 1 23 45 67 89", "+49 (0)30/1234567", "+442079460123"]
    cards = ["4539 5787 6362 1486", "4539-5787-6362-1486", "3782 822463 10005", "4539578763621486"]
    dates = ["29.02.2024", "5.3.2024", "29/02/2024", "02/29/2024", "29-02-2024", "2024/02/29", "2024.02.29", "2024-02-29"]
    other = ["4539 5787 6362 1487", "30.02.2024", "13/13/2024", "1990 1995 2000 2005"]
    frame = spark.createDataFrame(list(enumerate(phones + cards + dates + other)), "doc_id long, text string")
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(frame, "key").collect()}
    out = {text: got[k].text for k, text in enumerate(phones + cards + dates + other)}
    assert [t for t in phones + cards + dates if out[t] == t] == [] and all(got[k].n_found == 1 for k in range(len(phones + cards + dates)))
    assert all(re.sub(r"\d", "0", out[t]) == re.sub(r"\d", "0", t) for t in phones + cards + ["29.02.2024", "2024/02/29"])
    assert all(out[t].startswith(c) for t, c in zip(phones, ("+1", "+1-", "+1.", "+33 ", "+49 (", "+44"), strict=True))
    assert all(luhn(re.sub(r"\D", "", out[t])) == 0 for t in cards) and len({re.sub(r"\D", "", out[t]) for t in cards if t[0] == "4"}) == 1
    assert all(out[t] == t for t in other)
    day = np.datetime64(out["2024-02-29"])
    for t, form in (("29.02.2024", "{2}.{1}.{0}"), ("29/02/2024", "{2}/{1}/{0}"), ("29-02-2024", "{2}-{1}-{0}"), ("2024/02/29", "{0}/{1}/{2}"), ("2024.02.29", "{0}.{1}.{2}")):
        assert out[t] == form.format(*str(day).split("-"))
    month, number, year = out["02/29/2024"].split("/")
    assert int(number) > 12 and np.datetime64(f"{year}-{month}-{number}")
    text = "Call +33 1 23 45 67 89 97.51.17.173, +1 (017) 555-7713 2024-02-29 or 4539 5787 6362 1486 12 times"
    row = pseudonyms.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), "key").first()
    assert row.n_found == row.n_replaced == 5 and row.text.endswith(f"{out['4539 5787 6362 1486']} 12 times") and out["+33 1 23 45 67 89"] + " " in row.text
    days = spark.range(73049).selectExpr("date_add(date'1900-01-01', cast(id AS int)) AS d").where("day(d) > 12").selectExpr("1L AS doc_id", "date_format(d, 'MM/dd/yyyy') AS text")
    assert pseudonyms.pseudonymise(days, "key").where("substr(text, 4, 2) > 12").select("text").distinct().count() == days.count()


def test_pseudonyms_of_very_long_texts(spark, empty):
    """Repeats of a million labels, digits, signs and groups neither overflow a stack nor hide what follows."""
    tail = " 97.51.17.173 was.91@mail6.example.com"
    many = ["x@" + "a." * 1_000_000 + "com", "7" * 1_000_000, "@" * 1_000_000, "+" * 1_000_000, "+1" * 500_000, "1." * 500_000, "+1 (2" * 200_000,
            "1234 " * 200_000, "a.b@c.d" * 100_000, "%-" * 500_000, "2024-02-29-" * 90_000, "x" * 1_000_000 + "@a.com"]
    frame = spark.createDataFrame([(k, text + tail) for k, text in enumerate(many)], "doc_id long, text string")
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(frame, "key").collect()}
    made = pseudonyms.pseudonymise(spark.createDataFrame([(0, tail)], "doc_id long, text string"), "key").first().text
    assert len(got) == len(many) and all(got[k].text.endswith(made) and got[k].n_found >= 2 for k in range(len(many)))
    assert all(len(got[k].text) >= len(text) for k, text in enumerate(many))
    assert pseudonyms.pseudonymise(empty, "key").count() == 0


def test_pseudonyms_found_values_equal_brute_force(spark):
    """Values found in a whole table, by the same patterns in another matcher, each text alone."""
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pattern = re.compile(pseudonyms.VALUE, re.ASCII)
    want = {r.doc_id: len(pattern.findall(r.text or "")) for r in frame.collect()}
    assert {r.doc_id: r.n_found for r in pseudonyms.pseudonymise(frame, "key").collect()} == want and sum(want.values()) > 0


def test_pipeline_stages(spark, docs):
    folder = "/root/testdata/sf0.001"
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, folder).cache()
        assert out.columns == frame.columns, name
        assert 0 < out.count() <= frame.count()
        frame = out
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, folder)
    assert packed.select("doc_id").distinct().count() == frame.count()
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).count()
        stage(spark, docs.where("false"), folder).count()
