"""Licence scans against brute force: windows, matching statistics and chains."""

import random
import re

import pytest

from tarnsift.llm import license_scan as L
from tests.llm.cases import awkward, docs, empty, prose

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def cut(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(text):
    w = cut(text)
    return sorted((k, label) for p, label in BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())


def statistics(w, templates):
    """The longest run ending at each word, by looking for it in all templates."""
    joined = [f" {' '.join(t)} " for t in templates]
    out, n = [], 0
    for k in range(len(w)):
        n = min(n + 1, k + 1)
        while n and not any(f" {' '.join(w[k - n + 1 : k + 1])} " in t for t in joined):
            n -= 1
        out.append(n)
    return out


def anchors(w, template, longest, run):
    found = []
    for k, n in enumerate(longest):
        ends = k + 1 == len(w) or longest[k + 1] != n + 1
        if n >= run and ends:
            part = w[k - n + 1 : k + 1]
            found += [(k - n + 1, n, a) for a in range(len(template) - n + 1) if template[a : a + n] == part]
    return sorted(found, key=lambda x: (x[0] + x[1], x[0], x[2]))


def best_chain(found, gap):
    """The most words that a chain covers, looking at every pair of anchors."""
    best = []
    for k, (t, n, a) in enumerate(found):
        top = n
        for (u, m, b), had in zip(found[:k], best):
            dt, da = t - (u + m - 1), a - (b + m - 1)
            lost = max(0, 1 - dt, 1 - da)
            if dt <= gap + 1 and da <= gap + 1 and lost < n:
                top = max(top, had + n - lost)
        best.append(top)
    return max(best, default=0)


def texts():
    r = random.Random(5)
    notices = [n for _, n in L.NOTICES]
    out = [n.upper() for n in notices] + [f"{prose(80 + k, 30)} {n} {prose(90 + k, 30)}" for k, n in enumerate(notices)]
    pool = sorted({x for n in notices for x in cut(n)})
    out += [" ".join(r.choices(pool, k=200)) for _ in range(10)]
    for n in notices:  # words lost, put in and doubled
        w = n.split()
        for _ in range(3):
            at = r.randrange(len(w))
            out.append(" ".join(w[:at] + r.choices(pool, k=r.randint(0, 9)) + w[at + r.randint(0, 3) :] + w[: r.randint(0, len(w))]))
    out += ["MIT License mit-license, MIT\nLICENSE. mit éLicense", "CC BY-NC 4.0 cc by", "gnu gnu general public license apache license", "mit", "x CC\x1cBY y"]
    return out


def test_places_words_and_labels(spark):
    rows = awkward() + [(1000 + k, t, None, None, None) for k, t in enumerate(texts())] + [(None, "apache license", None, None, None)] * 2
    text = {i: t for i, t, *_ in rows}
    got = L.op11(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        places, w = base(text[r.doc_id]), cut(text[r.doc_id])
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert {x for _, x in places} <= set(r.labels.split(",")) and r.labels == ",".join(sorted(set(r.labels.split(","))))
        assert 0 <= r.score <= 1 and (not places or r.score == 1)
    by = {r.doc_id: r.labels.split(",") for r in got}
    assert all(label in by[1000 + k] and label in by[1000 + len(L.NOTICES) + k] for k, (label, _) in enumerate(L.NOTICES))
    assert all(by[i] == [""] for i, *_ in awkward())
    assert L.op11(empty(spark)).count() == 0


def test_statistics_and_chains_by_brute_force():
    made = L.Scanner()
    templates = [cut(t) for t, _ in L.PHRASES] + [cut(t) for _, t in L.NOTICES]
    for t in texts():
        w = cut(t)
        longest = statistics(w, templates)
        ids = list(made.auto.code(t.encode()))
        walked = {at: n for at, n, _ in made.auto.walk(ids[0])} if ids else {}
        assert walked == {k: n for k, n in enumerate(longest) if n > 1}
        score = 1.0 if base(t) else 0.0
        for template in templates[len(L.PHRASES) :]:
            score = max(score, min(1.0, best_chain(anchors(w, template, longest, L.RUN), L.GAP) / len(template)))
        (n, _, spans, got), = made.scan([t.encode()])
        assert n == len(w) and got == pytest.approx(score)
        for s in spans:
            assert 0 <= s["first"] <= s["last"] < n and s["share"] >= L.SHARE


def test_streams_long_texts_in_pieces(monkeypatch):
    made, text = L.Scanner(), " ".join(texts()).encode()
    whole = list(made.scan([text, None, b"", text]))
    monkeypatch.setattr(L, "PIECE", 7)
    monkeypatch.setattr(L, "SPAN", 50)
    monkeypatch.setattr(L.Automaton, "code", lambda self, t: (L.np.array([self.ids.get(w, -1) for w in p], L.np.int32) for p in L.pieces(t or b"", 7)))
    assert list(made.scan([text, None, b"", text])) == whole
    assert whole[0] == whole[3] and whole[1] == whole[2] == (0, [], [], 0.0)


def test_repeated_notices_are_spans_of_their_own(spark):
    rows = [(1, "Released under the MIT License. " * 5000, None, None, None)]
    r = L.scan(docs(spark, rows)).first()
    assert len(r.places) == 5000 and len(r.spans) == 5000 and {s.share for s in r.spans} == {1.0}
