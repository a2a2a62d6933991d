import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from termloom.llm import alignment, queries

from .cases import AWKWARD, documents

ODD = [
    "<|endoftext|> </s> <s> [INST]", "a▁b", "  two  spaces ", " \n x\n\n  y \t z", "don't it's  we'll", "x" * 3000, " " * 5000, "\n" * 700 + "end", "a b 　 c", "1234567 12 3", "漢字かな交じり文 と 한국어", "🙂🙃 👩‍👩‍👧", "naïve façade é", "tab\tand \r\n line", "\x00\x01 \x7f", "a  b a  b", "same words same words",
    "no-break thin ﻿ bom", "ﬁ ligature ½ ² Å", "a \u0085b", "x \x1c y", "-- -- --", " leading", "trailing ", "  line",
]


@pytest.fixture(scope="module")
def plain():
    """Both tokenizers without any of the operator's code: token ids and bytes of a text, or None."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(sorted(set(range(256)) - set(own)))}

    def b_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    def tokens(text):
        if not text:
            return None
        x = a.encode(" " + text, add_special_tokens=False)
        ta = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in x.ids]
        tb = [(i, b_bytes(i)) for i in b.encode(text)]
        whole = (" " + text).encode()
        return (ta, tb) if b"".join(t for _, t in ta) == whole == b"".join(t for _, t in tb) else None

    return tokens


def brute(rows, tokens):
    facts, holds = [], Counter()
    for doc_id, text in rows:
        groups, found = [], tokens(text)
        if found:
            ta, tb = ([(i, end) for (i, _), end in zip(t, np.cumsum([len(x) for _, x in t]).tolist())] for t in found)
            ends_b, ga, gb = {e for _, e in tb}, [], []
            common = sorted(e for _, e in ta if e in ends_b)
            start = 0
            for e in common:
                groups.append(([i for i, x in ta if start < x <= e], [i for i, x in tb if start < x <= e]) if len(common) < 400 else None)
                start = e
            if None in groups:  # long texts: one walk
                groups, i, j = [], 0, 0
                for e in common:
                    ga, gb = [], []
                    while i < len(ta) and ta[i][1] <= e:
                        ga.append(ta[i][0])
                        i += 1
                    while j < len(tb) and tb[j][1] <= e:
                        gb.append(tb[j][0])
                        j += 1
                    groups.append((ga, gb))
        links = Counter()
        for x, y in groups:
            cx, cy = Counter(x), Counter(y)
            for u in cx:
                for v in cy:
                    links[u, v] += cx[u] * cy[v]
        holds.update(links.keys())
        facts.append((doc_id, groups, links))
    most = defaultdict(int)
    for (u, _), n in holds.items():
        most[u] = max(most[u], n)
    out = []
    for doc_id, groups, links in facts:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()), sum(n for p, n in links.items() if holds[p] == most[p[0]]), sum(n * holds[p] for p, n in links.items()), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def test_awkward_texts_against_brute_force(spark, plain):
    texts = AWKWARD + ODD
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    expected = brute(rows, plain)
    df = documents(spark, texts, extra=True)
    assert sorted((tuple(r) for r in alignment.summary(df).collect()), key=str) == expected
    assert sorted((tuple(r) for r in alignment.summary(df, most_pairs=10).collect()), key=str) == expected  # the shuffled form
    assert alignment.summary(df.limit(0)).collect() == []


def test_query_over_the_tables(spark, plain):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op13_alignment(spark, "/root/testdata/sf0.001").collect()), key=str) == brute(rows, plain)


def test_groups_as_text(spark):
    got = {r.doc_id: r.groups for r in alignment.aligned(documents(spark, ["ab", None]), groups=True).collect()}
    assert got[1] == "" and got[0].count("|") == 1 + got[0].count(";")


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1 << 15])
def test_merge_path_pieces(size):
    rng = np.random.default_rng(size)
    for n, m in [(1, 1), (5, 400), (400, 5), (300, 300), (0, 0)]:
        end = 1000 if n else 0
        a, b = (np.array(sorted({*rng.choice(np.arange(1, end + 1), k).tolist(), end}) if k else [], np.int64) for k in (n, m))
        i, j = alignment.merge_path(a, b, size)
        assert (np.diff(i + j)[:-1] == size).all() and (i[-1], j[-1]) == (len(a), len(b))
        expected = [(e, int((a < e).sum()), int((b < e).sum()), e in a and e in b) for e in sorted({*a.tolist(), *b.tolist()})]
        assert list(zip(*(x.tolist() for x in alignment.overlaps(a, b, size)))) == expected
        common = np.intersect1d(a, b)
        for x, group in zip((a, b), alignment.groups_of(a, b, size)):
            assert (group == np.searchsorted(common, x)).all()


def test_many_tokens_in_one_group():
    """Links of a group are counted by distinct ids: 10^10 of them at once."""
    a, b = np.arange(100_000) % 3, np.arange(100_000) % 2
    zero = np.zeros(100_000, np.int64)
    group, pair, links = alignment.linked(a, b, zero, zero)
    assert len(pair) == 6 and links.sum() == 10**10
