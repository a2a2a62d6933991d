import random
import re

from termloom.llm import licenses as L

from .cases import AWKWARD, documents


def brute(text, threshold=0.9):
    """All templates against the whole text, its paragraphs and lines, without bounds or index."""
    def grams(t):
        t = re.sub(r"(?im)^\W*copyright\s*(?:\(c\)|©|\d{4}).*$", "", t)
        w = [x for x in re.split(r"[\W_]+", t.lower()) if x]
        return set(zip(w, w[1:]))

    text, found = text or "", []
    spans = {(0, len(text))} | {(m.start(), m.end()) for m in re.finditer(r"[^\n]+", text)}
    at = 0
    for part in text.split("\n\n"):
        spans.add((at, at + len(part)))
        at += len(part) + 2
    for a, b in spans:
        g, best = grams(text[a:b]), (0, "")
        for name in sorted(L.TEMPLATES, reverse=True):
            for t in L.TEMPLATES[name]:
                h = grams(t)
                s = 2 * len(g & h) / (len(g) + len(h)) if g and b > a else 0
                best = max(best, (s, name), key=lambda x: x[0]) if s != best[0] else (s, name)
        if best[0] >= threshold and b > a:
            found.append((a, -b, best[1], round(best[0], 9)))
    return sorted(found)


def texts():
    rng = random.Random(9)
    out = []
    for name, ts in L.TEMPLATES.items():
        for t in ts:
            w = t.split(" ")
            for _ in range(3):
                x = list(w)
                for _ in range(rng.randrange(4)):
                    x[rng.randrange(len(x))] = "changed"
                out.append(" ".join(x))
            out += [f"Copyright (c) 2020 Someone\n\n{t}", f"Some words before.\n{t}\n\nAnd after.", t.upper()]
    return out


def test_brute_force(spark):
    df = documents(spark, [*AWKWARD, *texts()], extra=True)
    rows = df.select("doc_id", "text").collect()
    expected = sorted((str(r.doc_id), brute(r.text)) for r in rows)
    got = sorted((str(r.doc_id), [(m.start, -m.end, m.license, round(m.score, 9)) for m in r.matches]) for r in L.scan_licenses(df).collect())
    assert got == expected


def test_summary(spark):
    df = documents(spark, ["Words.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.", "none", None])
    out = {r.doc_id: tuple(r)[1:] for r in L.summary(L.scan_licenses(df)).collect()}
    assert out == {0: ("CC-BY-NC-4.0", 1.0, 2, "CC-BY-NC-4.0,MIT"), 1: (None, None, 0, ""), 2: (None, None, 0, "")}
    assert L.scan_licenses(df.limit(0)).collect() == []


def test_licences_inside_longer_documents(spark):
    """Several paragraphs of a notice, a notice in mid-line, and full texts are found where they stand."""
    lines = lambda name: L.TEMPLATES[name][0].replace("MIT License\n", "").replace("\n", "\n\n")
    filler = " ".join(f"word{i}" for i in range(3000))
    around = "# A tool\n\nIt does this and that.\n\n{}\n\nSee the other files. " + filler
    full = L.all_templates()
    parts = {"MIT": lines("MIT"), "BSD-2-Clause": lines("BSD-2-Clause"), "ISC": lines("ISC"), "Apache-2.0": full["Apache-2.0"][-1].strip(), "GPL-2.0": full["GPL-2.0"][-1].strip(), "GPL-3.0": full["GPL-3.0"][-1].strip()}
    texts = [around.format(p) for p in parts.values()] + ["Words come first. Licensed under CC BY 4.0. Words come last, and more of them.", "Nothing is licensed here.", "", None]
    found = {r.doc_id: r.matches for r in L.scan_licenses(documents(spark, texts), full, inside=True).collect()}
    for i, (name, part) in enumerate(parts.items()):
        best = max(found[i], key=lambda m: m.end - m.start)
        assert best.license == name and best.score > 0.95 and best.end - best.start > 0.95 * len(part)
    assert [(m.license, m.score, texts[6][m.start : m.end]) for m in found[6]] == [("CC-BY-4.0", 1.0, "Licensed under CC BY 4.0")]
    assert not any(found[i] for i in (7, 8, 9))


def test_repeated_notices_are_found_in_linear_time(monkeypatch):
    """The windows of repeated texts are those of reading on to the text's end, and two megabytes take seconds."""
    import random
    import time

    from termloom.llm import licenses

    mit = licenses.all_templates()["MIT"]
    mit = mit if isinstance(mit, str) else mit[0]
    rng, words = random.Random(3), mit.split()
    texts = [" ".join([mit] * 12), " ".join(words[20:] * 9 + ["x"] * 40 + words), "a b c " * 900 + mit, " ".join(w for _ in range(14) for w in (words if rng.random() < 0.6 else rng.sample(words, len(words)))), " ".join(rng.choice(words) for _ in range(4000))]
    monkeypatch.setattr(licenses, "REPEATED", 1 << 40)
    whole = [licenses.Matcher(licenses.all_templates()).windows(t) for t in texts]
    for limit in (0, 2, 8):
        monkeypatch.setattr(licenses, "REPEATED", limit)
        assert [licenses.Matcher(licenses.all_templates()).windows(t) for t in texts] == whole
    matcher, began = licenses.Matcher({"MIT": [mit]}), time.process_time()
    found = matcher.windows(" ".join([mit] * (2_000_000 // len(mit)) + [f"other{i}" for i in range(1000)]))
    assert len(found) > 1500 and time.process_time() - began < 60
