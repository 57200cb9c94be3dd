import hashlib
import heapq
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from cases import ROWS, documents
from tokenizers import Tokenizer

from ligatable.llm import alignment, queries

A, B = queries.tokenizer_path(queries.BYTE_TOKENIZER), queries.tokenizer_path(queries.PIECE_TOKENIZER)


def brute(rows):
    """Whole texts, token by token, straight from the definition."""
    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=B)
    sign = alignment.byte_signs()

    def bytes_b(i):
        p = two.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()

    docs, held = [], Counter()
    for doc_id, text in rows:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        bytes_a = [bytes(sign[c] for c in one.id_to_token(i)) for i in a]
        parts_b = [bytes_b(i) for i in b]
        if not text or not (b"".join(bytes_a) == (" " + text).encode() == b"".join(parts_b)):
            docs.append((doc_id, [], [], 0, [], ""))
            continue
        end_a, end_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in parts_b]).tolist()
        links, i, j = [], 0, 0
        groups, left, right = [], [], []
        while i < len(a):
            links.append((a[i], b[j]))
            x, y = end_a[i], end_b[j]
            if x <= y:
                left.append(str(a[i]))
                i += 1
            if y <= x:
                right.append(str(b[j]))
                j += 1
            if x == y:
                groups.append(",".join(left) + "|" + ",".join(right))
                left, right = [], []
        held.update(set(links))
        docs.append((doc_id, a, b, len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    return [
        (doc_id, len(a), len(b), groups, len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), sha)
        for doc_id, a, b, groups, links, sha in docs
    ]


def order(rows):
    return sorted(map(tuple, rows), key=str)


ODD = [
    "a  b\n\tc <s> </s> <unk> <|endoftext|> é 日本",
    "trailing spaces   ",
    " ",
    "   ",
    "\n",
    "x ",
    " x",
    "a literal ▁ mark and▁one",
    "▁",
    "<0x41> \x00 nul",
    "bell\x07 sep\x1c \x1d unit\x1f next\x85 nbsp\xa0 wide　 zero​ width",
    "a \n b\n  c   d\t\t e",
    "it's we'll I'd 'tis  can't",
    "emoji 👩‍👩‍👧 flags 🇩🇪 ﬁ ﬂ ａｂ é",
    "नमस्ते दुनिया مرحبا بالعالم שלום 你好，世界。 안녕하세요",
    "1234567890 1 22 333 3.14 1e9",
    "--- *** /// ((( ~~~~~~~~~~~~~~~~",
]


def test_equals_brute_force_on_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = queries.op11_token_alignment(spark, sf_dir)
    assert order(got.collect()) == order(brute(docs.select("doc_id", "text").collect()))


@pytest.mark.parametrize("small", [False, True])
def test_awkward_documents(spark, monkeypatch, small):
    """Odd signs, nulls, repeated rows, long texts; blocks, runs and steps cut short."""
    if small:
        monkeypatch.setattr(alignment, "BLOCK_CHARS", 400)
        monkeypatch.setattr(alignment, "STEP_CHARS", 60)
        monkeypatch.setattr(alignment, "KNOWN_CHUNKS", 20)
        monkeypatch.setattr(alignment, "RUN_RECORDS", 3)
    rows = [*ROWS, *((100 + i, t, "en", "a", 1) for i, t in enumerate(ODD * 3))]
    got = alignment.aligned_documents(documents(spark, rows), A, B, ranges=7 if small else 256, fan_in=2 if small else 64)
    assert order(got.collect()) == order(brute([r[:2] for r in rows]))


def test_random_signs(spark):
    rng = random.Random(4)
    signs = [" ", " ", " ", "\n", "\t", "a", "the", "'s", "é", "日", " ", "\x1c", "!", "9", "👍", "ing"]
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randrange(30))), "en", "a", 1) for i in range(400)]
    got = alignment.aligned_documents(documents(spark, rows), A, B)
    assert order(got.collect()) == order(brute([r[:2] for r in rows]))


def test_no_documents(spark):
    got = alignment.aligned_documents(documents(spark, []), A, B)
    assert got.count() == 0 and got.columns[0] == "doc_id"
    blank = alignment.aligned_documents(documents(spark, [(1, None, "en", "a", 0), (2, "", "en", "a", 0)]), A, B)
    assert order(blank.collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_runs_round_trip_and_merge():
    rng = random.Random(0)
    runs = [sorted((p, rng.randrange(1, 2**40)) for p in rng.sample(range(2**33), rng.choice([0, 1, 9000]))) for _ in range(7)]
    written = [alignment.written_run(r) for r in runs]
    assert [[tuple(x) for part in alignment.read_run(w) for x in part.tolist()] for w in written] == runs
    want = Counter()
    for r in runs:
        for p, n in r:
            want[p] += n
    assert list(alignment.merged(written + written)) == [(p, 2 * n) for p, n in sorted(want.items())]
    assert list(alignment.merged([])) == list(heapq.merge())
