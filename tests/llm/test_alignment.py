import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from modlens.llm.alignment import A_FILE, B_FILE, Summary, Tokenizers, alignments, lanes_of, link_counts, lockstep
from modlens.llm.common import documents

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def both():
    return Tokenizers(open(A_FILE, "rb").read(), open(B_FILE, "rb").read())


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    table = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(x): x for x in table} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in table)}

    def tokens(text):
        """Whole texts, one at a time: (A ids, A bytes), (B ids, B bytes); nothing where the bytes differ."""
        e = a.encode(" " + text, add_special_tokens=False)
        x = (e.ids, [bytes(letter[c] for c in t) for t in e.tokens])
        ids = b.encode(text)
        y = (ids, [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
                   for i, p in zip(ids, map(b.id_to_piece, ids))])
        want = (" " + text).encode()
        return (x, y) if text and b"".join(x[1]) == want == b"".join(y[1]) else (([], []), ([], []))

    return tokens


def brute(tokens, rows):
    """Group by group, from the ends of whole texts."""
    docs, counts = [], Counter()
    for key, text in rows:
        (a, x), (b, y) = tokens(text or "")
        a_end, b_end = np.cumsum([len(t) for t in x]).tolist(), np.cumsum([len(t) for t in y]).tolist()
        cuts = sorted(set(a_end) & set(b_end))
        groups, links, p, q = [], [], 0, 0
        place = {e: k for k, e in enumerate(a_end)}, {e: k for k, e in enumerate(b_end)}
        for c in cuts:
            i, j = place[0][c], place[1][c]
            groups.append(",".join(map(str, a[p:i + 1])) + "|" + ",".join(map(str, b[q:j + 1])))
            links.append((a[i], b[j]))
            p, q = i + 1, j + 1
        counts.update(links)
        docs.append((key, len(a), len(b), groups, links))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return sorted(((key, na, nb, len(g), len(k), sum(counts[p] == best[p[1]] for p in k), sum(counts[p] for p in k),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for key, na, nb, g, k in docs), key=str)


def result(df, **kw):
    return sorted((tuple(r) for r in link_counts(df, **kw).collect()), key=str)


TEXT = st.text(st.one_of(st.sampled_from("abc  \n\t'.,1é中▁ \xa0𝄞"), st.characters(codec="utf-8")), max_size=60)


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(TEXT, max_size=5), lane=st.sampled_from([1, 3, 1000]))
def test_lanes_give_the_tokens_of_whole_texts(both, plain, texts, lane):
    s = Summary(both, texts, lane, chunk=20)
    want = brute(plain, list(enumerate(texts)))
    assert [(k, *s.sizes[k].tolist(), s.digests[k]) for k in range(len(texts))] == [(*w[:4], w[7]) for w in want]


@pytest.mark.parametrize("lane", [2, 37, 1000])
def test_given_texts_in_lanes_of_any_size(spark, both, plain, lane):
    rows = [(r["doc_id"], r["text"][:5000]) for r in documents(spark, SF001).collect()]
    s = Summary(both, [t for _, t in rows], lane, chunk=3000)
    for (_, text), size, digest in zip(rows, s.sizes.tolist(), s.digests):
        (want,) = brute(plain, [(0, text)])
        assert (*size, digest) == (*want[1:4], want[7])


def test_lanes():
    assert lanes_of("one two  three \n four five", 1) == ["one", "two  three \n four", "five"]
    assert lanes_of("x" * 50, 10) == ["x" * 50]
    assert lanes_of(" lead and trail ", 3) == [" lead", "and", "trail "]


def test_lockstep_merge():
    a, b = [2, 5, 6, 3, 4], [5, 6, 1, 2, 4]
    i, j = lockstep(np.array(a), np.array([0, 3, 3, 5]), np.array(b), np.array([0, 2, 2, 5]), np.array([True, False, True]))
    assert i.tolist() == [1, 2, 4] and j.tolist() == [0, 1, 4]


@pytest.mark.parametrize("head", [1 << 20, 200, 0])
def test_against_brute_force(spark, plain, head):
    docs = documents(spark, SF001)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rows = [(k, t) for k, t in rows if len(t) < 20_000]
    got = result(spark.createDataFrame(rows, "doc_id bigint, text string"), head=head)
    assert got == brute(plain, rows)


@pytest.mark.parametrize("head", [1 << 20, 3])
def test_edge_cases(spark, docs_frame, plain, head):
    rows = [(1, None), (2, ""), (3, " "), (4, "a"), (5, "with ▁ inside"), (6, "<s> <|endoftext|> </s> <unk> <0x41>"),
            (7, "tab\tand\nline\r\n  two  blanks "), (8, "né 中文 𝄞 \x00 nul"), (4, "a"), (4, "a"), (None, "no id"),
            (9, "x" * 3000), (10, "中文。" * 700), (11, "good " * 400 + "▁"), (12, "same"), (13, "same")]
    assert result(docs_frame(rows, extra=True), head=head) == brute(plain, rows)


def test_long_text_and_empty_table(spark, docs_frame, long_text, plain):
    got = result(docs_frame([(1, long_text[:2_000_000]), (2, "short")]))
    (a, x), (b, y) = plain(long_text[:2_000_000])
    cuts = len(np.intersect1d(np.cumsum([len(t) for t in x]), np.cumsum([len(t) for t in y])))
    assert got[0][:5] == (1, len(a), len(b), cuts, cuts)
    assert result(docs_frame([])) == []


def test_alignments_hold_tokens_and_cuts(spark, docs_frame, plain):
    rows = [(1, "An unhyphenated, misspelt wrod. " * 90), (2, None), (3, "▁"), (4, "é𝄞"), (None, "x y")]
    got = {r["doc_id"]: r for r in alignments(docs_frame(rows, extra=True), lane=40).collect()}
    for key, text in rows:
        (a, x), (b, y) = plain(text or "")
        assert (got[key]["a_ids"], got[key]["b_ids"]) == (a, b)
        cut = zip(got[key]["a_cuts"], got[key]["b_cuts"])
        assert [sum(map(len, x[:i])) for i, _ in cut] == sorted(
            set(np.cumsum([len(t) for t in x]).tolist()) & set(np.cumsum([len(t) for t in y]).tolist()))
        assert all(b"".join(x[:i]) == b"".join(y[:j]) for i, j in zip(got[key]["a_cuts"], got[key]["b_cuts"]))
