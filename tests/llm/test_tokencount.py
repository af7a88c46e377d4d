import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trawl.llm import pretokens, tokencount

TEXTS = ["Hello  World's end\n\n", None, "", "a " * 700, "été ß 12²", "日本 x ", "a<|endoftext|>b", "one one one", "x" * 20_000, "one one one"]


@pytest.mark.parametrize("table_size", [65_536, 3])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_are_those_of_the_library(spark, name, table_size):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    df = spark.createDataFrame([(k if k else None, t, 7, False) for k, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int, over_limit boolean").repartition(3)
    got = {r.doc_id: r for r in tokencount.count_tokens(df, path, 512, table_size=table_size).collect()}
    assert len(got) == len(TEXTS)
    for k, t in enumerate(TEXTS):
        r, n = got[k or None], len(library.encode(t or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((t or "").encode()), n, n > 512)
    assert tokencount.count_tokens(df.limit(0), path, 512).count() == 0


def test_the_table_holds_the_most_frequent_pieces(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([("one two one",), ("one two three",), (None,), ("日本 one one",)], "text string")
    table = tokencount.frequent_lengths(df, "text", path, 2)
    assert list(table) == [" two", "one"] or list(table) == ["one", " two"]
    assert all(v == 1 for v in table.values())


def test_the_cache_is_bounded():
    encoder = pretokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), most=20, known={"the": 1}, lengths=True)
    for k in range(50):
        encoder(f"word{k} other{k} the")
        assert len(encoder.known) <= 20 + 10
    assert encoder.known["the"] == 1
