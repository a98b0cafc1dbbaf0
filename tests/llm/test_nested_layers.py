"""Secrets behind random nestings of encodings, and hostile texts that stay cheap."""

import base64
import bz2
import gzip
import random
import time
import zlib
from urllib.parse import quote

import pytest

from aerostrata.llm import secrets

SECRET = "password=Zx81kQpL0aPq7"


def b64(data: bytes) -> str:
    return base64.b64encode(data).decode()


#: name: (encoder of text, whether each character keeps a place of its own)
LAYERS = {
    "percent": (lambda s: "".join(f"%{b:02x}" for b in s.encode()), True),
    "some percent": (lambda s: quote(s, safe="abcdefgh"), True),
    "unicode": (lambda s: "".join(f"\\u{ord(c):04x}" for c in s), True),
    "braces": (lambda s: "".join(f"\\u{{{ord(c):x}}}" for c in s), True),
    "long unicode": (lambda s: "".join(f"\\U{ord(c):08x}" for c in s), True),
    "percent unicode": (lambda s: "".join(f"%u{ord(c):04X}" for c in s), True),
    "hex": (lambda s: "".join(f"\\x{ord(c):02x}" for c in s), True),
    "octal": (lambda s: "".join(f"\\{ord(c):03o}" for c in s), True),
    "references": (lambda s: "".join(f"&#{ord(c)};" for c in s), True),
    "hex references": (lambda s: "".join(f"&#x{ord(c):x};" for c in s), True),
    "base64": (lambda s: b64(s.encode()), False),
    "base64 of utf-16": (lambda s: b64(s.encode("utf-16-le")), False),
    "gzip": (lambda s: b64(gzip.compress(s.encode())), None),
    "gzip in zlib": (lambda s: b64(zlib.compress(gzip.compress(s.encode()))), None),
    "zlib in bzip2": (lambda s: b64(bz2.compress(zlib.compress(s.encode()))), None),
    "url gzip": (lambda s: quote(gzip.compress(s.encode())), None),
}


@pytest.mark.parametrize("seed", range(60))
def test_a_secret_is_found_behind_any_nesting(seed):
    """Characters with places of their own give the exact span; base64 gives it to a group, compressed data the whole region."""
    rng = random.Random(seed)
    names = [rng.choice(sorted(LAYERS)) for _ in range(rng.randint(1, 4))]
    code, exact = f"see {SECRET} there", True
    for name in names:
        code, kept = LAYERS[name][0](code), LAYERS[name][1]
        exact = None if kept is None or exact is None else exact and kept
        if len(code) > 60_000:
            return
    text = f"before {code} after"
    start, end = 7, 7 + len(code)
    found = [s for s in secrets.all_spans(text) if s[2] == "assign_layer"]
    inside = [s for s in found if start <= s[0] and s[1] <= end]
    assert inside, (names, found, text[:200])
    if exact:
        each = (end - start) / len(f"see {SECRET} there")
        want = (start + 4 * each, start + (4 + len(SECRET)) * each)
        if all(n != "some percent" and "references" not in n and n not in ("braces", "octal") for n in names):
            assert any(abs(a - want[0]) < 1 and abs(b - want[1]) < 1 for a, b, _ in inside), (names, inside, want)


@pytest.mark.parametrize("text", [
    "%" + "25" * 50_000 + "70assword=Zx81kQpL0aPq7",
    "\\" + "u005c" * 20_000 + "u0070assword=Zx81kQpL0aPq7",
    "%" * 50_000 + "3" * 49_999 + "70assword=Zx81kQpL0aPq7",
    "%5cu0025" * 12_000 + "70assword=Zx81kQpL0aPq7",
])
def test_deep_escapes_take_one_pass(text):
    began = time.perf_counter()
    found = secrets.all_spans(text)
    assert time.perf_counter() - began < 5
    assert any(s[2] == "assign_layer" and s[1] == len(text) for s in found)


def test_members_joined_letters_and_broken_data():
    plain = gzip.compress(b"nothing to see here") + gzip.compress(SECRET.encode())
    for code in (b64(plain), "key" + b64(gzip.compress(SECRET.encode())), "ab_" + b64(zlib.compress(SECRET.encode()))):
        assert any(s[2] == "assign_layer" for s in secrets.all_spans(f"x {code} y"))
    cut = gzip.compress((SECRET + " " + "filler " * 50).encode())[:-12]  # broken at its end
    assert any(s[2] == "assign_layer" for s in secrets.all_spans(b64(cut)))
    for code in ("eJ" * 200, "H4sI" * 200, b64(b"BZh9" + bytes(60)), "%1f%8b%08" + "%00" * 50):
        assert not any(s[2] == "assign_layer" for s in secrets.all_spans(code))
    bomb = zlib.compress(zlib.compress(bytes(30_000_000)))
    assert secrets.all_spans(b64(bomb)) is not None
