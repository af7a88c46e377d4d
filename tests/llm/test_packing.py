import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trawl.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello World, hello!", None, "", "a " * 700, "été ß 12", "日本 x", "<|endoftext|> y", "one", "x" * 5000] * 3


def pieces_of(spark, width, parts, texts=TEXTS):
    rows = [(k if k != 5 else None, t, "clash", 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, part int").repartition(parts)
    return packing.pack(df, PATH, 1, width)


@pytest.mark.parametrize("width, parts", [(2048, 3), (64, 4), (7, 2), (1, 2)])
def test_every_id_lies_in_one_piece_and_sequences_have_no_gaps(spark, width, parts):
    library = Tokenizer.from_file(PATH)
    want = {k if k != 5 else None: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for k, t in enumerate(TEXTS)}
    rows = pieces_of(spark, width, parts).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == want.keys()
    for k, mine in by_doc.items():
        at = 0
        for r in sorted(mine, key=lambda r: r.start):
            ids = want[k][r.start : r.start + r.length]
            assert (r.start, r.doc_tokens, r.length) == (at, len(want[k]), len(ids)) and r.ids_crc32 == zlib.crc32(ids.tobytes()) and bytes(r.ids) == ids.tobytes()
            at += r.length
        assert at == len(want[k])
    total = sum(map(len, want.values()))
    assert sorted(by_sequence) == list(range(-(-total // width)))
    for s, mine in by_sequence.items():
        at = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        last = s == max(by_sequence)
        assert at == (total - s * width if last else width)
        assert {r.padded_length for r in mine} == {at if last and at & (at - 1) == 0 else width}


@pytest.mark.parametrize("width, parts", [(50, 4), (7, 3)])
def test_sequences_are_the_stream_in_windows(spark, width, parts):
    pieces = pieces_of(spark, width, parts).persist()
    stream = b"".join(bytes(r.ids) for r in sorted(pieces.collect(), key=lambda r: (r.sequence_id, r.offset)))
    flat = np.frombuffer(stream, "<u4").tolist()
    got = sorted(packing.sequences(pieces, width, pad_id=9).collect())
    assert [r.sequence_id for r in got] == list(range(len(got)))
    assert [x for r in got for x in r.ids[: r.used]] == flat and all(set(r.ids[r.used :]) <= {9} for r in got)
    assert all(len(r.ids) == width for r in got[:-1])
    pieces.unpersist()


def test_empty_table_and_padding(spark):
    assert pieces_of(spark, 64, 2, [None]).count() == 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty, PATH).count() == 0 and packing.sequences(packing.pack(empty, PATH)).count() == 0
    assert [packing.padded_length(n, 2048) for n in (1, 3, 1024, 1025, 2048)] == [1, 2048, 1024, 2048, 2048]
