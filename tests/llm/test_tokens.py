import random

import pytest
from tokenizers import Tokenizer, models, normalizers

from fieldtrace.llm import tokens as T

PATH = "/opt/tokenizers/piece_bpe_32k.model"


def reference(pieces, fallback):
    t = Tokenizer(models.Unigram(pieces, 0, fallback))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return lambda text: len(t.encode(text, add_special_tokens=False).ids) if text else 0


def best_path(pieces, text):
    """Pieces of the best path by trying every piece at every place; unknown characters count as their bytes."""
    scores, longest = dict(pieces), max(len(p) for p, _ in pieces)
    unknown = min(scores.values()) - T.UNKNOWN_PENALTY
    text = T.SPACE + text.replace(" ", T.SPACE)
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        found = None
        for start in range(max(0, end - longest), end):
            piece, (score, n) = text[start:end], best[start]
            if piece in scores:
                found = max(found or (-float("inf"), 0), (score + scores[piece], n + 1), key=lambda x: x[0])
            elif start == end - 1:
                found = max(found or (-float("inf"), 0), (score + unknown, n + len(piece.encode())), key=lambda x: x[0])
        best.append(found)
    return best[-1][1]


def test_control_and_byte_pieces_are_plain_text():
    pieces, fallback = T.read_vocabulary(PATH)
    counter = T.Counter(pieces, fallback)
    assert [counter.count(t) for t in ("x</s>", "a<0x0A>b", "word<unk>")] == [4, 8, 5]
    for text in ["<s>in</s> <0xE2>\n<unk>é", "plain words", "<0x0A>" * 30, "日 <s"]:
        assert counter.count(text) == best_path(pieces, text)


def test_production_vocabulary(spark, docs, no_docs):
    pieces, fallback = T.read_vocabulary(PATH)
    # The reference needs the byte pieces by name to fall back to them.
    count = reference([("<unk>", 0.0), *pieces, *((f"<0x{i:02X}>", 0.0) for i in range(256))], fallback)
    counter = T.Counter(pieces, fallback)
    assert counter.by_word
    for text in ["Hello  world\nx  ", "日本語 😀 test\t\n\n a", "   ", "\n", "", "é" * 40]:
        assert counter.count(text) == count(text)
    rows = T.token_counts(docs, PATH).collect()
    assert all(r["tokens"] == count(r["doc"]["text"]) for r in rows) and len(rows) == docs.count()
    assert T.token_counts(no_docs, PATH).count() == 0


@pytest.mark.parametrize("fallback", [False, True])
def test_ties_of_random_vocabularies(fallback):
    rng = random.Random(6)
    for _ in range(80):
        names = {"".join(rng.choice("ab▁c") for _ in range(rng.randint(1, 4))) for _ in range(12)}
        pieces = [("<unk>", 0.0), *((p, float(rng.randint(-4, 0))) for p in sorted(names))]
        pieces += [(f"<0x{i:02X}>", -9.0) for i in range(256)] if fallback else []
        counter, count = T.Counter(pieces, fallback), reference(pieces, fallback)
        for _ in range(15):
            text = "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 25)))
            assert counter.count(text) == count(text)
