"""License scans against the longest common subsequence of every window."""

import random
import time

import pytest

from stradale.llm import licenses

R = random.Random(11)


def longest(a, b):
    """Length of a longest common subsequence, by its recurrence."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    return row[-1]


def prose(r, n):
    return [r.choice("the of and to in a is that for it work under public version any with you or this general".split() + [f"w{r.randint(0, 200)}" for _ in range(30)]) for _ in range(n)]


def damaged(r, template, k):
    words = licenses.tokens(template)
    words = [w.decode() for w in words]
    for _ in range(k):
        at, what = r.randrange(len(words)), r.random()
        words[at : at + (what < 0.6)] = [] if what < 0.3 else [f"z{r.randint(0, 99)}"]
    return words


@pytest.mark.parametrize("seed", range(4))
def test_every_window_that_covers_a_template_is_found(seed):
    r = random.Random(seed)
    names = ["mit", "gpl-3.0", "cc-by-4.0", "bsd-line", "apache-2.0"]
    scanner = licenses.Scanner({k: licenses.TEMPLATES[k] for k in names})
    for _ in range(25):
        name = r.choice(names)
        n = len(scanner.templates[name])
        words = prose(r, 40) + damaged(r, licenses.TEMPLATES[name], r.randint(0, n // 4)) + prose(r, 40)
        text = " ".join(words)
        found = [x for x in scanner.scan(text.encode()) if x[0] == name]
        tokens, template = licenses.tokens(text), scanner.templates[name]
        best = max(longest(tokens[a : a + n + max(2, n // 4)], template) for a in range(len(tokens)))
        if best >= licenses.COVERAGE * n:
            assert found
        for _, share, first, last in found:
            inside = longest(licenses.tokens(text.encode()[first:last]), template)
            assert licenses.COVERAGE <= share and round(share * n) <= inside


def test_alignment_against_the_longest_subsequence():
    """Never longer; as long where every word is unique."""
    r = random.Random(5)
    for _ in range(300):
        a, b = ([r.choice(b"abcdefgh") for _ in range(r.randint(0, 12))] for _ in "xy")
        assert len(licenses.align(a, b)) <= longest(a, b)
        a, b = (r.sample(range(30), r.randint(0, 15)) for _ in "xy")
        assert len(licenses.align(a, b)) == longest(a, b)


def test_stretches_leave_strays_out():
    notice = licenses.TEMPLATES["mit-text"].replace("sublicense, ", "").replace("substantial ", "")
    strays = "sublicense " + "lorem " * 34
    text = f"{strays}{notice} {'ipsum ' * 34}substantial"
    (found,) = [x for x in licenses.Scanner(licenses.TEMPLATES).scan(text.encode()) if x[0] == "mit-text"]
    assert text[found[2] : found[3]].startswith("Permission is hereby") and found[3] <= len(strays) + len(notice)


def test_every_template_is_found_in_prose_and_only_there():
    r = random.Random(3)
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        whole = " ".join([*prose(r, 60), text, *prose(r, 60)])
        hits = [x for x in scanner.scan(whole.encode()) if x[0] == name]
        assert len(hits) == 1 and hits[0][1] > 0.95  # prose of the same words may take a place


def test_long_text_of_near_notices_takes_no_long():
    text = ("Permission is granted to use copy modify distribute this software without restriction subject to conditions. " * 1500).encode()
    began = time.process_time()
    licenses.Scanner(licenses.TEMPLATES).scan(text)
    assert len(text) > 150_000 and time.process_time() - began < 6
