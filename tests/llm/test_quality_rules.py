import re
from collections import Counter, defaultdict

import pytest

from secretsieve.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    seen, doubles = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            doubles += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), doubles, len(covered)


def test_statistics_match_plain_python(table, corpus):
    rows = [*corpus, (500, "a b c d e f a b c d e g\n#|<> x\n#|<> x\n \n", "s"), (501, "p q r s t " * 30, "s"), (502, "a a a a a a", "s")]
    got = quality_rules.judge(table(rows)).collect()
    have = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got)
    want = Counter()
    for doc, text, *_ in rows:
        s = plain(text)
        want[(doc, *s, s[0] < 10 or 100 * s[4] > 20 * s[0])] += 1
    assert have == want


def normal(line):
    return " ".join(WORD.findall(line.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))))


def verdicts(rows, min_docs, max_share=None):
    contents = {(s, t or ""): set() for _, t, s in rows}
    for d, t, s in rows:
        contents[s, t or ""].add(d)
    hosts = Counter(s for s, _ in contents)
    docs, keeper = Counter(), {}
    for (s, t), ids in contents.items():
        for line in {normal(x) for x in t.split("\n")} - {""}:
            docs[s, line] += 1
            keeper[s, line] = min([*ids, keeper.get((s, line), 10**9)])
    out = []
    for d, t, s in rows:
        over = [x for x in (t or "").split("\n") if docs[s, normal(x)] > min(min_docs, (max_share or min_docs) * hosts[s]) and keeper[s, normal(x)] != d]
        n, lost = plain(t)[0], sum(len(WORD.findall(x)) for x in over)
        failed = n < 10 or 100 * plain(t)[4] > 20 * n
        depleted = lost > 0 and (n - lost < 10 or n - lost < 0.3 * n)
        kept = not failed and not depleted
        text = "\n".join(x for x in t.split("\n") if x not in over) if t else t
        out.append((d, n - lost, depleted, kept, text))
    return out


@pytest.fixture
def boilerplate():
    line = "Welcome to our site  please read all of the terms below"
    rows = []
    for i in range(40):
        own = " ".join(f"w{i}x{k}" for k in range(30 if i % 2 else 4))
        rows.append((i, f"{line if i % 3 else line.upper()}\n{own}\n{line}", "a"))
    rows += [(100 + i, " ".join(f"v{i}x{k}" for k in range(25)), "a") for i in range(20)]
    rows += [(200 + i, f"{line}\n" + " ".join(f"u{i}x{k}" for k in range(20)), None) for i in range(3)]
    rows += [(300 + i, " ".join(f"copy{k}" for k in range(40)), "b") for i in range(30)]
    return rows


@pytest.mark.parametrize("max_share", [None, 0.05, 0.9])
def test_frequent_lines_and_depleted_documents(table, boilerplate, max_share):
    got = quality_rules.judge(table(boilerplate), min_docs=5, max_share=max_share).collect()
    want = verdicts(boilerplate, 5, max_share)
    assert sorted((r["doc_id"], r["n_left"], r["depleted"], r["kept"]) for r in got) == sorted(x[:4] for x in want)
    assert sum(x[2] for x in want) >= 19  # the short ones but the first
    cleaned = quality_rules.clean(table(boilerplate), min_docs=5, max_share=max_share)
    assert cleaned.columns == table([]).columns
    assert sorted((r["doc_id"], r["text"]) for r in cleaned.collect()) == sorted((x[0], x[4]) for x in want if x[3])


def test_the_limit_does_not_grow_with_the_host(table, boilerplate):
    """Ten copies of the table with a changed word each: what was over the limit stays over it."""
    over = lambda rows: {x for r in quality_rules.judge(table(rows), min_docs=20).collect() if r["removed"] for x in r["removed"]}
    many = [(1000 * k + d, f"{t}\nchanged{k} and a few further words", s) for k in range(10) for d, t, s in boilerplate]
    assert over(boilerplate) and over(boilerplate) <= over(many)
    # A host with as many other documents again changes nothing.
    others = [(50_000 + i, " ".join(f"z{i}x{k}" for k in range(12)), "a") for i in range(900)]
    assert over(boilerplate) == over(boilerplate + others)


def test_edge_rows(table, corpus):
    rows = {r["doc_id"]: r for r in quality_rules.judge(table(corpus)).collect()}
    assert rows[300]["base_failed"] and rows[301]["n_words"] == 0 and not rows[302]["kept"]
    assert quality_rules.clean(table(corpus)).filter("doc_id = 7").count() == 2
    assert quality_rules.judge(table([])).count() == 0 and quality_rules.clean(table([])).count() == 0
