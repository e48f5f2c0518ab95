import random
from itertools import combinations

from helixbench.llm import licenses


def test_rising_against_all_subsets():
    rng = random.Random(1)
    for _ in range(100):
        pairs = list(enumerate(rng.sample(range(30), rng.randrange(9))))
        want = max((n for n in range(len(pairs) + 1) for c in combinations(pairs, n) if all(x[1] < y[1] for x, y in zip(c, c[1:], strict=False))), default=0)
        got = licenses.rising(pairs)
        assert len(got) == want and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(new[-1], row[j]))
        row = new
    return row[-1]


def test_alignments_are_common_subsequences():
    rng = random.Random(2)
    full = 0
    for _ in range(300):
        template = [f"w{rng.randrange(25)}" for _ in range(rng.randrange(1, 30))]
        text = [w for w in template if rng.random() < 0.9]
        for _ in range(rng.randrange(8)):
            text.insert(rng.randrange(len(text) + 1), f"x{rng.randrange(9)}")
        got = licenses.align(text, template)
        assert all(text[i] == template[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
        most = longest_common(text, template)
        assert len(got) <= most
        full += len(got) == most
    assert full > 150


def test_signs_are_needed_for_coverage():
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.75, 2.0)
    for name, template in scanner.templates.items():
        assert sum(w not in scanner.signs[name] for w in template) / len(template) < 0.75


def test_planted_licenses(spark):
    rng = random.Random(5)
    filler = lambda n: " ".join(f"f{rng.randrange(200)}" for _ in range(n))
    rows, want = [], {}
    for i, (name, text) in enumerate(licenses.TEMPLATES.items()):
        rows.append((i, filler(30) + "\n" + text.upper() + "\n" + filler(2000)))
        want[i] = name
        words = text.split()
        if len(words) > 20:
            for _ in range(3):
                words[rng.randrange(len(words))] = "changed"
            rows.append((100 + i, filler(5) + " " + " // ".join(words)))
            want[100 + i] = name
    line = licenses.TEMPLATES["All rights reserved"]
    rows += [(500, f"{line} " * 40 + filler(9) + f" {line} {line}"), (501, None), (502, ""), (503, filler(500)), (504, "the license version reserved under rights")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, license string, start int")
    got: dict[int, list] = {}
    for r in licenses.license_spans(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, name in want.items():
        found = [r for r in got[i] if r.license == name]
        assert len(found) == 1 and found[0].coverage >= 0.75
        if i < 100:
            assert found[0].coverage == 1.0
            part = rows[[r[0] for r in rows].index(i)][1][found[0].start : found[0].end]
            assert licenses.words(part) == licenses.words(licenses.TEMPLATES[name])
    assert len([r for r in got[500] if r.license == "All rights reserved"]) >= 40
    assert not set(got) & {501, 502, 503, 504}
    assert licenses.license_spans(df.limit(0)).count() == 0


def scan(text, **more):
    return licenses.Scanner(more.pop("templates", licenses.TEMPLATES), more.pop("least", 0.75), more.pop("spread", 2.0)).scan(text)


def test_places_count_characters_of_the_text():
    text = "İİİİ Released under the MIT License. tail"
    (found,) = scan(text)
    assert text[found[4] : found[5]] == "Released under the MIT License"


def test_fillers_nested_and_adjacent_licenses():
    name, text = "MIT grant", licenses.TEMPLATES["MIT grant"]
    template = licenses.words(text)
    for fillers in (1, 3):
        broken = " ".join(w + " zzz" * fillers for w in template)
        assert [r[0] for r in scan(broken, spread=fillers + 1.0)] == [name] and (fillers == 1 or not scan(broken))
    assert [r[0] for r in scan(licenses.TEMPLATES["Apache-2.0 header"])] == ["Apache-2.0 header"]
    assert [r[0] for r in scan(licenses.TEMPLATES["MIT text"])] == ["MIT text"]
    twice = text + " " + text.replace("merge", "purge")
    n = len(template)
    assert [(r[0], r[2], r[3]) for r in scan(twice)] == [(name, 0, n - 1), (name, n, 2 * n - 1)]


def test_every_window_that_covers_a_template_is_met():
    rng = random.Random(7)
    found_some = 0
    for _ in range(150):
        template = [f"w{rng.randrange(12)}" for _ in range(rng.randrange(4, 14))]
        tokens = []
        for _ in range(rng.randrange(1, 4)):
            tokens += [f"w{rng.randrange(14)}" for _ in range(rng.randrange(12))]
            tokens += [x for w in template if rng.random() < 0.93 for x in ([w, "zz"] if rng.random() < 0.2 else [w])]
        got = scan(" ".join(tokens), templates={"t": " ".join(template)})
        assert all(x[3] < y[2] for x, y in zip(got, got[1:], strict=False))
        assert all(r[6] >= 0.75 and r[3] - r[2] < 2 * len(template) for r in got)
        for a in range(len(tokens)):
            pairs = licenses.align(tokens[a : a + 2 * len(template)], template)
            if len(pairs) >= 0.75 * len(template):
                found_some += 1
                assert any(r[2] <= a + pairs[-1][0] and a + pairs[0][0] <= r[3] for r in got)
    assert found_some > 100


def test_null_keys_repeats_and_a_long_text(spark):
    line = "Released under the MIT License."
    rows = [(None, line), (1, line), (1, line), (2, "word " * 400_000 + line)]
    got = sorted(((r.doc_id, r.license, r.first_word) for r in licenses.license_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == [(1, "MIT", 0), (1, "MIT", 0), (2, "MIT", 400_000), (None, "MIT", 0)]


def test_common_length_against_the_table():
    rng = random.Random(11)
    for _ in range(300):
        template = [f"w{rng.randrange(9)}" for _ in range(rng.randrange(1, 90))]
        text = [f"w{rng.randrange(11)}" for _ in range(rng.randrange(90))]
        assert licenses.common_length(text, licenses.masks(template), len(template)) == longest_common(text, template)


def test_shuffled_words_of_a_template_cost_few_alignments(monkeypatch):
    rng, asked = random.Random(12), []
    plain = licenses.align
    monkeypatch.setattr(licenses, "align", lambda a, b: asked.append(1) or plain(a, b))
    template = licenses.words(licenses.TEMPLATES["MIT text"])
    text = [w for _ in range(100) for w in rng.sample(template, len(template))]
    assert [r[0] for r in scan(" ".join([*text, *template, *text[:900]])) if r[0] == "MIT text"] == ["MIT text"]
    assert len(asked) < len(text) / 20
