"""Repeated passages inside lines against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from patentframe.llm import linededup, wordruns
from tests.llm.test_operators import document_order, plain, words

SPACES = " \t\n\x0b\f\r"


def split(text):
    """(word, white space after it) of a text; the first word may be empty, before leading white space."""
    out = []
    for c in text:
        if c in SPACES and out:
            out[-1][1] += c
        elif c in SPACES:
            out.append(["", c])
        elif not out or out[-1][1]:
            out.append([c, ""])
        else:
            out[-1][0] += c
    return out


def brute_passages(data, least):
    """Text left of each distinct (id, text), by comparing all windows of ``least`` words."""
    keyed = document_order(data)
    pieces = [split(t) for _, t in keyed]
    where = defaultdict(list)
    for n, own in enumerate(pieces):
        own = [w for w, _ in own if w]
        for a in range(len(own) - least + 1):
            where[tuple(own[a : a + least])].append((n, a))
    gone = defaultdict(set)
    for found in where.values():
        first = min(found)
        for n, a in found:
            if n != first[0] or a >= first[1] + least:
                gone[n] |= set(range(a, a + least))
    left = {}
    for n, key in enumerate(keyed):
        lead, text = int(bool(pieces[n]) and not pieces[n][0][0]), ""
        for k, (w, space) in enumerate(pieces[n]):
            if k - lead not in gone[n]:
                text += w + space
            elif k + 1 - lead not in gone[n] and "\n" in space:
                text += "\n"
        left[key] = (text, bool(gone[n]))
    return left


def passage_docs(rng, n):
    """Texts of unlike words with pieces of a few long passages inside their lines, white space of all kinds between."""
    passages = [words(rng, 90).split() for _ in range(4)]
    data = []
    for k in range(n):
        own = []
        for _ in range(rng.randint(0, 4)):
            own += words(rng, rng.randint(0, 30)).split()
            p, a = rng.choice(passages), rng.randint(0, 50)
            own += p[a : a + rng.randint(10, 60)] if rng.random() < 0.8 else []
        data.append((k, "".join(rng.choice(["", " ", "\n"]) if not i else rng.choice([" ", " ", "\n", " \r\n", "\t"]) * bool(i) + w for i, w in enumerate(["", *own]))))
    return data


def test_passages_against_all_windows(spark):
    data = passage_docs(random.Random(5), 60)
    same = "x " * 30  # repeats itself, with and without overlap
    data += [(100, None), (101, ""), (102, " \n "), (103, same), (104, same + "  y"), (None, data[3][1]), (None, None), data[5], data[5], (105, data[7][1])]
    data += [(106, " ".join(w for _, t in data[:40] for w in t.split()))]
    want = brute_passages(data, 20)
    docs = spark.createDataFrame([(i, t, "kept", len(t or "")) for i, t in data], "doc_id long, text string, hash string, n_chars int").repartition(5)
    got = plain(wordruns.drop_passages(docs, 20))
    rows = [(i, *want[i, t or ""], t) for i, t in data]
    expected = sorted((i is not None, i or 0, t is not None, (left if t is not None else "")) for i, left, changed, t in rows if not changed or left.strip(SPACES))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or "") for r in got) == expected
    assert all(r["n_chars"] == len(r["text"] or "") and r["hash"] == "kept" for r in got)
    assert sum(c for _, _, c, _ in rows) > 20 and len(got) < len(data)


def test_passages_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, n_chars int")
    assert wordruns.drop_passages(none).count() == 0 and wordruns.drop_passages(none).columns == none.columns


@pytest.mark.parametrize("least", [2, 3, 20, 50])
def test_equal_passages_take_equal_hashes(least):
    """Wherever a passage stands again, without overlap, its hash is taken at least twice and both places are among those taken."""
    rng = random.Random(least)
    texts = [" ".join(rng.choice("ab") if rng.random() < 0.3 else words(rng, 1) for _ in range(rng.randint(0, 150))) for _ in range(12)]
    texts += ["z " * 200, texts[0] + " " + texts[1], " ".join(texts[2].split()[3:] * 3), ""]
    own, start, size, gram = wordruns.sampled([t.encode() for t in texts], least)
    taken, n = {}, defaultdict(int)
    for t, s, z, g in zip(own.tolist(), start.tolist(), size.tolist(), gram.tolist()):
        n[g] += 1
        taken |= {(t, s + k): g for k in range(z)}
    assert set(taken) == {(t, a) for t, x in enumerate(texts) for a in range(len(x.split()) - least + 1)}
    where = defaultdict(list)
    for t, a in taken:
        where[tuple(texts[t].split()[a : a + least])].append((t, a))
    for found in where.values():
        grams = {taken[p] for p in found}
        assert len(grams) == 1
        if any(t != found[0][0] or abs(a - found[0][1]) >= least for t, a in found):
            assert n[grams.pop()] > 1


def test_slide_joins_all_sizes():
    x = np.arange(40)[::-1] * 7 % 41
    for size in range(1, 45):
        assert wordruns.slide(x, size, np.minimum).tolist() == [min(x[k : k + size]) for k in range(40 - size + 1)]


def test_line_runs_stay_as_they_were(spark):
    """What line runs delete goes before; a passage that begins inside a line goes after."""
    rng = random.Random(1)
    p = words(rng, 60)
    docs = spark.createDataFrame([(0, words(rng, 20) + " " + p + " " + words(rng, 5)), (1, words(rng, 9) + " " + p + "\nend")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in plain(linededup.drop_runs(docs))} == {r["doc_id"]: r["text"] for r in plain(docs)}
    second = next(r["text"] for r in plain(docs) if r["doc_id"])
    assert {r["doc_id"]: r["text"] for r in plain(wordruns.drop_passages(docs))}[1] == second.replace(p, "")
