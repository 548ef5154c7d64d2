"""Results of the pipeline and of language ID against plain Python over the whole small table."""

import re
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tessella.llm import language, packing
from tessella.llm.tokens import tokenizer_path

FOLDER = "/root/testdata/sf0.001"
ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def accepted(docs, languages):
    """Smallest compressed size over blocks, block by block, with a margin to the next."""
    import zstandard

    out = []
    for row in docs:
        text = row["text"]
        if not text or not any(c.isalpha() for c in text):
            continue
        data, sizes = language.letters(text), []
        for tool in languages.compressors():
            assert isinstance(tool, zstandard.ZstdCompressor)
            sizes.append(sum(len(tool.compress(data[at : at + language.BLOCK])) for at in range(0, len(data), language.BLOCK)))
        best, second = sorted(sizes)[:2]
        if second - best >= max(1, language.MARGIN * second):
            out.append((row, languages.names[sizes.index(best)]))
    return out


def without_lines(docs):
    """Later occurrences of three consecutive lines that are not blank go."""
    first, windows = {}, {}
    for row in sorted(docs, key=lambda r: r["doc_id"]):
        lines = (row["text"] or "").split("\n")
        solid = [i for i, line in enumerate(lines) if line.strip(" \t\r")]
        windows[row["doc_id"]] = lines, solid
        for k in range(len(solid) - 2):
            first.setdefault(tuple(lines[i] for i in solid[k : k + 3]), (row["doc_id"], k))
    out = []
    for row in docs:
        lines, solid = windows[row["doc_id"]]
        gone = {i for k in range(len(solid) - 2) if first[tuple(lines[i] for i in solid[k : k + 3])] != (row["doc_id"], k) for i in solid[k : k + 3]}
        text = "\n".join(line for i, line in enumerate(lines) if i not in gone)
        out.append(row | {"text": text, "n_chars": len(text)})
    return out


def one_of_each(docs):
    """Fingerprints of three-word shingles, all pairs, smallest id of each group."""
    prints = {}
    for row in docs:
        words = re.findall("[^\x20\x09-\x0d]+", lowered(row["text"]))
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        bits = sum(np.array([xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for b in range(64)]) for s in shingles) if shingles else np.zeros(64)
        prints[row["doc_id"]] = sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))
    group = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if bin(prints[a] ^ prints[b]).count("1") <= 2 and group[a] < group[b]:
                    group[b], changed = group[a], True
    return [row for row in docs if group[row["doc_id"]] == row["doc_id"]]


def not_contaminated(docs, items):
    windows = set()
    for item in items:
        words = ITEM_WORD.findall(lowered(item["text"]))
        windows |= {tuple(words[k : k + 13]) for k in range(max(1, len(words) - 12))} if words else set()
    sizes = {len(w) for w in windows}
    out = []
    for row in docs:
        words, hit = ITEM_WORD.findall(lowered(row["text"])), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if not (hit and 20 * len(hit) >= len(words)):
            out.append(row)
    return out


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_language_equals_plain_compression(spark, documents):
    languages = language.learn(documents)
    rows = [r.asDict() for r in documents.collect()]
    got = {r.doc_id: r for r in language.identify(documents, languages).collect()}
    want = {row["doc_id"]: name for row, name in accepted(rows, languages)}
    assert {i for i, r in got.items() if r.accepted} == set(want) and all(got[i].lang_pred == name for i, name in want.items())
    assert all(r.held_out == (crc32(str(i).encode()) % 3 == 1) for i, r in got.items())


def test_pipeline_equals_brute_force(spark, documents):
    rows = [r.asDict() for r in documents.collect()]
    items = [r.asDict() for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    kept = [row for row, _ in accepted(rows, language.learn(documents))]
    kept = not_contaminated(one_of_each(without_lines(kept)), items)
    assert 0 < len(kept) < len(rows)

    from tokenizers import Tokenizer

    tool, got, places = Tokenizer.from_file(tokenizer_path(packing.TOKENIZER)), defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, FOLDER).collect():
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length <= packing.SIZE and r.ids_crc32 == crc32(r.ids)
        got[r.doc_id].append((r.piece, r.start, ids.tolist()))
        places[r.sequence_id].append((r.offset, r.length))
    want = {row["doc_id"]: tool.encode(row["text"] or "", add_special_tokens=False).ids + [packing.END_ID] for row in kept}
    assert got.keys() == want.keys()
    for i, pieces in got.items():
        pieces.sort()
        assert [p for p, _, _ in pieces] == list(range(len(pieces))) and sum((ids for _, _, ids in pieces), []) == want[i]
        assert all(len(ids) == packing.SIZE for _, _, ids in pieces[1:]) and [s for _, s, _ in pieces] == np.cumsum([0, *[len(ids) for _, _, ids in pieces[:-1]]]).tolist()
    for parts in places.values():
        parts.sort()
        assert [a for a, _ in parts] == np.cumsum([0, *[n for _, n in parts[:-1]]]).tolist() and sum(n for _, n in parts) <= packing.SIZE
    assert len(places) <= 1.05 * -(-sum(map(len, want.values())) // packing.SIZE) + 1
