import random
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nearlake.llm.encoding import Encoder
from nearlake.llm.packing import OpenBins, pack_documents, sequences
from nearlake.llm.token_files import read_token_files, write_token_files

from .conftest import edge_rows, prose

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def le(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_words_give_the_ids_of_whole_texts(path):
    whole = Tokenizer.from_file(path)
    encoder = Encoder(path, words=50)  # a small memo is cleared often
    texts = [r[1] or "" for r in edge_rows()] + [prose(s, 200) for s in range(20)]
    texts += ["it's 'll x's don't", "ÀÉÎ Σας ΣΑΣ İ ǅ", " a", "a ", "a\n b", "\n", "ﬁ ſ K", "a_b __c__ d-e 1,234.5", "é ́a", "x y", "a  b"]
    for text in texts:
        assert encoder.encode(text) == le(whole.encode(text, add_special_tokens=False).ids), text[:50]


def test_bins_never_overflow_and_the_fullest_closes():
    bins = OpenBins(10, 2)
    assert bins.place(6) == (0, 0)
    assert bins.place(5) == (1, 0)
    assert bins.place(4) == (0, 6)  # the least space that suffices
    assert bins.place(8) == (2, 0)
    assert bins.place(9) == (3, 0)  # closes bin 2, which is fuller than bin 1
    assert bins.place(5) == (1, 5)


def check_packing(rows, texts, capacity):
    whole = Tokenizer.from_file(BYTES)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc_id, copies in texts.items():
        ids = whole.encode(copies[0], add_special_tokens=False).ids + [2]
        pieces = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert len(pieces) == len(copies) * -(-len(ids) // capacity)
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(le(ids[r.start : r.start + r.length]))
        assert sum(r.length for r in pieces) == len(ids) * len(copies)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


def test_packing(edges, empty):
    texts = defaultdict(list)
    for r in edge_rows():
        texts[r[0]].append(r[1] or "")
    packed = pack_documents(edges, BYTES, capacity=64, with_ids=True)
    rows = packed.collect()
    n = check_packing(rows, texts, 64)
    total = sum(r.length for r in rows)
    assert n <= -(-total // 64) + 3
    joined = sequences(packed)
    assert joined.where(F.length("ids") != 4 * F.col("n_tokens")).count() == 0 and joined.count() == n
    assert pack_documents(empty, BYTES).count() == 0
    assert sorted(map(tuple, pack_documents(edges, BYTES, capacity=64).collect())) == sorted(tuple(r)[:5] + tuple(r)[6:] for r in rows)


def test_token_files(spark, edges, empty):
    manifest = write_token_files(edges, WORDS, 1)
    rows = sorted(read_token_files(manifest).collect(), key=lambda r: r.start)
    whole = Tokenizer.from_file(WORDS)
    ids = {r[0]: whole.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in edge_rows()}
    assert [r.doc_id for r in rows] == sorted(r[0] for r in edge_rows())
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[r.doc_id]), zlib.crc32(le(ids[r.doc_id])))
        at += r.n_tokens
    assert {r.width for r in manifest.collect()} == {2}
    assert read_token_files(write_token_files(empty, WORDS, 1)).count() == 0


def test_rows_without_an_id(spark):
    rows = [(-1, "b"), (None, "a"), (None, "c"), (0, "d")]
    manifest = write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, 1)
    got = sorted(read_token_files(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, -1, 0]


def test_places_by_looking_at_every_bin():
    """The bitset finds the bin that going through all open bins finds."""
    r = random.Random(5)
    bins, free, limit = OpenBins(64, 5), {}, 5
    n = 0
    for _ in range(3000):
        length = min(64, max(1, int(r.expovariate(1 / 20))))
        fits = [(space, -b) for b, space in free.items() if space >= length]
        if fits:
            least = min(s for s, _ in fits)
            got, offset = bins.place(length)
            assert free[got] == least and offset == 64 - least
            free[got] -= length
        else:
            if len(free) == limit:
                fullest = min(free.values())
            got, offset = bins.place(length)
            assert (got, offset) == (n, 0)
            n += 1
            if len(free) == limit:
                still = {b for stack in bins.by_space for b in stack} | {got}
                (closed,) = set(free) - still
                assert free.pop(closed) == fullest
            free[got] = 64 - length
        if not free[got]:
            del free[got]
