"""op12 against plain loops over tokens."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from timelode.llm import alignment

BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = {chr(b): b for b in BYTES} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(BYTES))}
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def spelled(text):
    """Lists of (id, bytes) by the tokenizers' own calls, or nothing."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    if not text:
        return [], []
    one = [(i, bytes(LETTERS[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    two = [(i, bytes([int(p[3:5], 16)]) if p.startswith("<0x") else p.replace("▁", " ").encode()) for i, p in ((i, b.id_to_piece(i)) for i in b.encode(text))]
    want = (" " + text).encode()
    return (one, two) if b"".join(x for _, x in one) == want == b"".join(x for _, x in two) else ([], [])


def expected(rows):
    made, holders = [], Counter()
    for _, text in rows:
        sides = []
        for tokens in spelled(text):
            at, out = 0, []
            for i, piece in tokens:
                out.append((i, at, at + len(piece)))
                at += len(piece)
            sides.append(out)
        cuts = sorted({e for *_, e in sides[0]} & {e for *_, e in sides[1]})
        linked = [(i, j) for i, s, e in sides[0] for j, t, f in sides[1] if s < f and t < e]
        groups = []
        for lo, hi in zip([0, *cuts], cuts, strict=False):
            groups.append("|".join(",".join(str(i) for i, s, e in side if lo <= s and e <= hi) for side in sides))
        made.append((*map(len, sides), len(cuts), linked, ";".join(groups)))
        holders.update(set(linked))
    best = defaultdict(int)
    for (i, _), n in holders.items():
        best[i] = max(best[i], n)
    return [(a, b, g, len(k), sum(holders[p] == best[p[0]] for p in k), sum(holders[p] for p in k), hashlib.sha256(t.encode()).hexdigest() if t else "") for a, b, g, k, t in made]


TEXTS = [None, "", " ", "a", "a  b\n\tc", "<|endoftext|> and <s> <0x0A>", "▁ low", "é ü 漢字 🙂 done", "x" * 300, "unbelievable tokenization, unbelievable!", "unbelievable tokenization, unbelievable!", "\x00 nul \x7f", "ﬁ ﬁne é"]


@pytest.mark.parametrize("run", [1, 40, 4_000_000])
def test_every_count_by_plain_loops(spark, run):
    rows = list(enumerate(TEXTS)) + [(None, "a  b\n\tc"), (3, "a")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, run int, pair string").repartition(3)
    got = sorted(((r.doc_id is None, r.doc_id or 0), *(r[c] for c in COLUMNS)) for r in alignment.align(docs, run=run).collect())
    assert got == sorted(((d is None, d or 0), *e) for (d, _), e in zip(rows, expected(rows), strict=True))
    assert any(g[1] for g in got)


def test_whole_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    few = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 600]
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.align(spark.createDataFrame(few, "doc_id long, text string")).collect()}
    assert len(few) > 20 and got == {d: e for (d, _), e in zip(few, expected(few), strict=True)}


def test_links_themselves(spark, odd):
    for row in alignment.links(odd).collect():
        assert len(row.a_ids) == len(row.a_groups) and len(row.b_ids) == len(row.b_groups) and len(row.a_links) == len(row.b_links)
        assert all(row.a_groups[i] == row.b_groups[j] for i, j in zip(row.a_links, row.b_links, strict=True))
    assert alignment.align(odd).count() == odd.count()


def test_no_rows(none):
    assert alignment.align(none).collect() == []
