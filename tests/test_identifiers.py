"""Names in content: files inside of paths are not named again, and the bound on bytes is a parameter."""

import random
import re

from engram.functions import entities as N


def slow(text):
    """The rule read plainly, without a bound: every hit against every path."""
    paths = [m.span() for m in re.finditer(N.PATH, text)]
    hits = [(a, text[a:b]) for a, b in paths]
    for pattern in (N.BARE_FILE, N.CAMEL_CASE):
        hits += [(m.start(), m[0]) for m in re.finditer(pattern, text) if not any(a <= m.start() < b for a, b in paths)]
    hits += [(m.start(1), m[1]) for m in re.finditer(N.BACKTICK, text)]
    first = {}
    for place, raw in sorted(hits, key=lambda h: h[0]):
        first.setdefault(N.canon_text(raw), (place, raw))
    return [raw for _, raw in sorted((v for k, v in first.items() if k), key=lambda h: (h[0], -len(h[1])))]


def test_identifiers_match_the_plain_rule():
    rng = random.Random(3)
    parts = ["src/app/main.py", "main.py", "./a/b.ts", "DataFrame", "src/DataFrame/x.go", "`some code`", "`main.py`", "word", "x/y", "A/B.md,", "README.md", "(HttpServer)", "é"]
    for _ in range(200):
        text = rng.choice(["", " ", "/"]).join(rng.choice(parts) + rng.choice([" ", "\n", ""]) for _ in range(rng.randint(0, 14)))
        assert N.identifiers(text, 100) == slow(text), text


def test_bounds():
    text = "word " * 30_000 + "LateName " + " ".join(f"a/f{i}.py" for i in range(5000)) + " FileName"
    assert N.identifiers(text) == []
    assert N.identifiers(text, 2, most=None) == ["LateName", "a/f0.py"]
    assert len(N.identifiers(text, 10_000, most=None)) == 5002
    assert len(N.identifiers("a/b.py " * 3 + " ".join(f"Name{c}X" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) == N.MAX_ENTITIES
