import random
import types

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trawl.llm import pretokens

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@pytest.mark.parametrize("name", NAMES)
def test_every_pair_of_latin_characters_is_split_as_by_the_library(name):
    path = public_tokenizers.path(name)
    library, own = Tokenizer.from_file(path), pretokens.Encoder(path)
    assert own.kind
    texts = [chr(a) + chr(b) + chr(a) for a in range(256) for b in range(256)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own(text) == own.packed(want.ids), repr(text)


@pytest.mark.parametrize("name", NAMES)
def test_random_texts_and_odd_ones(name):
    path, rng = public_tokenizers.path(name), random.Random(5)
    library, own, lengths = Tokenizer.from_file(path), pretokens.Encoder(path, most=50), pretokens.Encoder(path, lengths=True)
    chars = "ab Zé ß1²\n\t\r\x1c\x85\xa0'sdl!?.,$%ñ_-" + "日İŒ́"
    texts = ["".join(rng.choice(chars[: rng.choice([20, len(chars)])]) for _ in range(rng.randrange(80))) for _ in range(3000)]
    texts += ["", " ", "a<|endoftext|>b", "<|startoftext|>", "x" * 5000, "  \n  don't  I'LL  "]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own(text) == own.packed(want.ids), repr(text)
        assert lengths(text) == len(want.ids)


def test_other_rules_of_the_same_shape_go_to_the_library(tmp_path):
    import json

    changes = {
        "byte_bpe_50k.json": [(("pre_tokenizer", "add_prefix_space"), True), (("pre_tokenizer", "use_regex"), False), (("normalizer",), {"type": "Lowercase"}), (("model", "ignore_merges"), True)],
        "word_bpe_49k.json": [(("pre_tokenizer", "pretokenizers", 0, "pattern", "Regex"), r"[\\p{L}]+|[\\p{N}]+"), (("pre_tokenizer", "pretokenizers", 0, "invert"), False), (("normalizer", "normalizers", 1, "content"), "_"), (("normalizer", "normalizers", 0, "type"), "NFKC")],
    }
    for name, each in changes.items():
        spec = json.loads(open(public_tokenizers.path(name), encoding="utf-8").read())
        for place, value in each:
            changed = json.loads(json.dumps(spec))
            at = changed
            for key in place[:-1]:
                at = at[key]
            at[place[-1]] = value
            stated = types.SimpleNamespace(to_str=lambda changed=changed: json.dumps(changed))
            assert pretokens.kind_of(stated) is None, place
        library = Tokenizer.from_str(json.dumps(changed))
        library.save(str(tmp_path / name))
        own = pretokens.Encoder(str(tmp_path / name))
        for text in ("don't stop 123 Éa", "a  b\n", ""):
            assert own(text) == own.packed(library.encode(text, add_special_tokens=False).ids)
