"""Secret scan against a row-by-row version with Python's regular expressions."""

import hashlib
import math
import random
import re

from chartmill.llm.secret_scan import BANDS, ENCODINGS, FALSE_SHARE, FOLDED, MOST_STEPS, STRAY, THIRD, scan_secrets

COLUMNS = "doc_id bigint, text string, spans string, tokens int, base string, m0 string, s0 int"


def brute_base(text):
    found = []
    names = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end()))
    for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 16), (2, "[0-9a-f]+", 32)):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(found)


def p_value(token):
    fits = [e for e in ENCODINGS if re.fullmatch(e.whole.strip("^$"), token)]
    if token.isdigit() or not fits:
        return None
    e = fits[0]
    t = token.lower() if e.name in FOLDED else token
    n, q = len(t), sum(t.count(c) ** 2 for c in set(t))
    s2 = e.collision
    s3 = THIRD * s2 * s2
    far = (n + n * (n - 1) * s2 - q) / math.sqrt(2 * n * (n - 1) * (s2 - s2 * s2 + 2 * (n - 2) * (s3 - s2 * s2)))
    v = [e.alphabet.index(c) + 1 for c in t]
    high = [x - 1 >= len(e.alphabet) / 2 for x in v]
    more = 2 * sum(high) * (n - sum(high)) / n
    spread = more * (more - 1) / (n - 1)
    over, under = n * sum(a * b for a, b in zip(v, v[1:] + v[:1])) - sum(v) ** 2, n * sum(a * a for a in v) - sum(v) ** 2
    if spread <= 0 or under == 0:
        return 1.0
    changes = 1 + sum(a != b for a, b in zip(high, high[1:]))
    serial = (over / under + 1 / (n - 1)) / (math.sqrt(n * (n - 3) / (n + 1)) / (n - 1))
    if abs((changes - more - 1) / math.sqrt(spread)) > STRAY or abs(serial) > STRAY or far <= 0:
        return 1.0
    return math.exp(-far * far / 2) / 12 + math.exp(-far * far * 2 / 3) / 4


def brute(rows):
    judged = []
    for i, text in rows:
        text = text or ""
        tokens = []
        for m in re.finditer("[A-Za-z0-9+/_-]{20,}", text):
            p = p_value(m[0])
            if p is not None:
                band = max(k for k, b in enumerate(BANDS) if len(m[0]) >= b)
                tokens.append((m.start(), m.end(), band, MOST_STEPS if p <= 0 else min(MOST_STEPS, math.floor(-10 * math.log10(p)))))
        judged.append((i, brute_base(text), tokens))
    least = {}
    for band in range(len(BANDS)):
        steps = sorted((t[3] for _, _, ts in judged for t in ts if t[2] == band), reverse=True)
        good = [s for s in set(steps) if 10 ** (-s / 10) <= FALSE_SHARE * sum(x >= s for x in steps) / len(steps)]
        if good:
            least[band] = min(good)
    out = []
    for i, base, tokens in judged:
        extra = [(a, 3, z) for a, z, band, step in tokens if band in least and step >= least[band] and not any(s <= a and e >= z for s, _, e in base)]

        def joined(spans):
            return ",".join(f"{('assign', 'access', 'hex', 'random')[k]}:{s}:{e}" for s, k, e in sorted(spans))

        count = [sum(k == n for _, k, _ in base) for n in range(3)]
        out.append((i, *count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + extra)))
    return sorted(out, key=str)


def scanned(spark, rows):
    frame = spark.createDataFrame([(i, t, "x", 1, "y", "z", 2) for i, t in rows], COLUMNS)
    return sorted([tuple(r) for r in scan_secrets(frame).collect()], key=str)


def token(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


def odd_rows():
    rng = random.Random(3)
    by = {e.name: e.alphabet for e in ENCODINGS}
    rows = [(0, None), (1, ""), (None, "token=abcdefgh"), (2, "no secret: here"), (3, "ſecret=abcdefghij toKen=abcdefghij Key")]
    rows += [(4, "token: api key secret: token: abcdefghij"), (5, 'Password" = "0123456789'), (6, "apikey:short API_KEY='a.b-c_d=e+f/g'"), (7, "AKIAAKIA12345678 AKIA1234 xAKIA" + "9" * 30)]
    rows += [(8, "\U0001f600" * 5 + "secret=abcdefgh " + "ab" * 20), (9, "0" * 31 + " " + "f" * 32 + "g" + "0123456789abcdef" * 4)]
    rows += [(10 + k, f"{'é' * k} {token(rng, by[name], n)} tail") for k, (name, n) in enumerate((name, n) for name in by for n in (20, 31, 40, 64, 200))]
    rows += [(100, "a_variable_name_that_is_very_long and/a/path/to/some/file-name-of-a-kind"), (101, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), (102, "x" * 100 + " " + "ab" * 50)]
    rows += [(103, "12345678901234567890123"), (104, "Donaudampfschifffahrtsgesellschaftskapitaen internationalization"), (105, "a+b_c-d/e" * 5), (106, token(rng, by["hex"], 40).upper())]
    rows += [(200, " ".join(token(rng, by["base62"], 40) for _ in range(300))), (201, "word " * 20_000 + "token=" + token(rng, by["base64url"], 43)), (202, token(rng, by["base64"], 30_000))]
    return rows + rows[-3:]


def test_against_brute_force(spark):
    rows = odd_rows()
    assert scanned(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert scanned(spark, []) == []


def test_battery_tells_secrets_from_text(spark):
    rng = random.Random(5)
    by = {e.name: e.alphabet for e in ENCODINGS}
    secrets = [(k, token(rng, by[("base62", "base64", "base64url")[k % 3]], 40 + k % 30)) for k in range(200)]
    words = "the quick brown fox jumps over lazy dogs while many other animals look on without any interest in what happens".split()
    names = [(1000 + k, "_".join(rng.choice(words) for _ in range(8))) for k in range(200)]
    found = {r[0] for r in scanned(spark, secrets + names) if r[5]}
    assert sum(i < 1000 for i in found) >= 190 and sum(i >= 1000 for i in found) <= 0.1 * len(found)
