import difflib
import random

from quillgraph.llm import licenses as L


def brute(text):
    """The best of every run of segments against every template, by words alone."""
    spots = [m.span() for m in L.SEGMENT.finditer(text) if m.end() > m.start()]
    best = (0.95, 0, None)
    for i in range(len(spots)):
        for j in range(i + 1, len(spots) + 1):
            block = L.words(text[spots[i][0] : spots[j - 1][1]])
            for name, template in L.TEMPLATES:
                t = L.words(template)
                if len(block) <= 1.3 * len(t):
                    ratio = difflib.SequenceMatcher(None, t, block, autojunk=False).ratio()
                    best = max(best, (ratio, len(t), name), key=lambda x: x[:2])
    return {best[2]} - {None}


def texts():
    rng = random.Random(2)
    junk = lambda n: " ".join("".join(rng.choice("aeionrst") for _ in range(rng.randrange(2, 9))) for _ in range(n)).capitalize() + "."
    out = [junk(30) for _ in range(5)] + ["A licence to print money. All warranty is void, permission denied, copyright mine."]
    for name, template in L.TEMPLATES:
        out.append(f"{junk(9)}\n{template}\n{junk(12)}")
        wrapped = template.split(" ")
        out.append(junk(4) + "\n" + "\n".join(" ".join(wrapped[k : k + 8]) for k in range(0, len(wrapped), 8)) + "\n" + junk(5))
        out.append(f"{junk(3)} {template.upper()} {junk(6)}")
    return out


def test_against_brute_force():
    for text in texts():
        assert {f["license"] for f in L.scan(text)} == brute(text), text


def test_wording_decides():
    said = "This work is licensed under the GNU General Public License, version {}."
    assert [f["license"] for f in L.scan(said.format(3))] == ["GPL-3.0"]
    assert [f["license"] for f in L.scan(said.format(2))] == ["GPL-2.0"]
    (found,) = L.scan("Released under the terms of the MIT License.")
    assert found["license"] == "MIT" and not found["differing"]
    assert L.scan("Released under some quite different terms than the MIT License.") == []
    (found,) = L.scan("This work is licensed under the GNU General Public Licence, version 3.")
    assert found["differences"] == [("license", "licence")] and found["differing"] == 1


def test_long_texts_and_places():
    text = "filler words here. " * 40_000 + "\nReleased under the MIT License.\n" + "more. " * 10 + "Licensed under CC BY-NC 4.0."
    found = L.scan(text)
    assert [(f["license"], text[f["start"] : f["end"]].strip()) for f in found] == [("MIT", "Released under the MIT License."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.")]


def test_rows(spark):
    rows = [(1, None), (2, ""), (None, "Released under the MIT License."), (3, "Released under the MIT License."), (3, "Released under the MIT License.")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license string")
    found = L.scan_licenses(df).collect()
    assert sorted((r.doc_id or -1, r.license, r.exact) for r in found) == [(-1, "MIT", True), (3, "MIT", True), (3, "MIT", True)]
    assert L.scan_licenses(df.limit(0)).count() == 0


def every_window(text):
    """The template that explains most of any word window of its length, from brute force."""
    said, best = L.words(text), (0, None)
    for name, template in L.TEMPLATES:
        t = L.words(template)
        for i in range(len(said) - len(t) + 1):
            n = L.differing(L.differences(said[i : i + len(t)], t))
            if n <= L.TOLERANCE * len(t):
                best = max(best, (len(t) - n, name), key=lambda x: x[0])
    return best[1]


def test_notices_inside_sentences():
    (found,) = L.scan("Code here is Licensed under CC BY 4.0 unless noted otherwise")
    assert found["license"] == "CC-BY-4.0" and not found["differing"]
    rng = random.Random(3)
    filler = lambda n: " ".join(rng.choice("amber birch cedar delta ember".split()) for _ in range(n))
    for name, template in L.TEMPLATES:
        text = f"{filler(5)} {template.rstrip('.')} {filler(7)}"
        assert [f["license"] for f in L.scan(text)] == [every_window(text)] == [name], text


def test_head_in_narrow_lines():
    for name, template in L.TEMPLATES:
        w = template.split(" ")
        lines = "\n".join(" ".join(w[k : k + 4]) for k in range(0, len(w), 4))
        (found,) = L.scan(f"amber birch\n{lines}\ncedar delta")
        assert found["license"] == name and found["differing"] == 0, lines


def test_what_tells_licences_apart():
    t = {}
    for name, template in L.TEMPLATES:
        t[name] = max(t.get(name, ""), template, key=len)
    for kind in ("BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause"):
        heads = [s for s in ("Redistributions of", "Redistributions in", "All advertising", "Neither the") if s in t[kind]]
        bullets, numbers = t[kind], t[kind]
        for k, s in enumerate(heads, 1):
            bullets, numbers = bullets.replace(s, f"\n* {s}"), numbers.replace(s, f"\n{k}. {s}")
        (found,) = L.scan(bullets)
        assert (found["license"], found["differing"]) == (kind, 0)
        (found,) = L.scan(numbers)
        assert (found["license"], found["differing"]) == (kind, len(heads))
    for kind in ("AGPL-3.0", "LGPL-2.1", "LGPL-2.0", "LGPL-3.0", "GPL-2.0", "GPL-3.0"):
        assert [(f["license"], f["differing"]) for f in L.scan(t[kind])] == [(kind, 0)]
    for kind in ("BY-ND", "BY-NC-SA", "BY-NC-ND", "BY-SA", "BY-NC", "BY"):
        assert [(f["license"], f["differing"]) for f in L.scan(f"Licensed under CC {kind} 4.0.")] == [(f"CC-{kind}-4.0", 0)]
    for other in ("Licensed under the Artistic License, Version 2.0.", "Licensed under the Apache License, Version 1.1.", "Licensed under CC BY-NC 3.0.", t["GPL-3.0"].replace("version 3", "version 4"), t["MPL-2.0"].replace("v. 2.0", "v. 1.1")):
        assert L.scan(other) == [], other
    said = "This work is licensed under "
    for other in ("a Creative Commons Attribution 3.0 International License.", "the GNU General Public License, version 1.", "the GNU Lesser General Public License, version 2.", "the GNU Affero General Public License, version 1."):
        assert L.scan(said + other) == [], other
    for kind, name in (("Attribution-NoDerivatives", "CC-BY-ND-4.0"), ("Attribution", "CC-BY-4.0")):
        assert [f["license"] for f in L.scan(f"{said}a Creative Commons {kind} 4.0 International License.")] == [name]


def exhaustive(text):
    """Differences of every word window, of any length a template may have, with every template; no compression, no segments, no cues."""
    said, found = L.words(text), set()
    for name, template in L.TEMPLATES:
        t = L.words(template)
        for i in range(len(said) - len(t) + 1):
            pairs = L.differences(said[i : i + len(t)], t)
            if L.differing(pairs) <= L.TOLERANCE * len(t) and not L.telling(pairs, t):
                found.add(name)
    return found


def test_nothing_that_could_be_confirmed_is_left_out():
    """Reworded notices: every licence that some window states is found where no better one overlaps."""
    rng = random.Random(5)
    for name, template in L.TEMPLATES:
        w = template.split(" ")
        for _ in range(2):
            changed = list(w)
            for k in rng.sample(range(len(w)), max(0, int(0.1 * len(w)))):
                changed[k] = rng.choice(["amber", "birch", changed[k] + " " + changed[k]])
            text = "cedar delta " + " ".join(changed) + " ember"
            found, could = {f["license"] for f in L.scan(text)}, exhaustive(text)
            assert bool(found) >= bool(could), text
            if len(could) == 1:
                assert found == could


def test_many_lines_without_words_are_quick():
    import time

    began = time.time()
    (found,) = L.scan("Released under the MIT License.\n" + "--\n" * 40_000)
    assert found["license"] == "MIT" and time.time() - began < 2
