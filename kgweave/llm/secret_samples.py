"""Labelled findings to learn from: values in lines of code, settings and prose.

A template says where a value stands and what its label is; values and the words around are drawn
by a fixed seed. Labels belong to the templates, so they follow no rule over features of values.
"""

from __future__ import annotations

import random
import string

SEED, EACH = 5, 14

# Words of the prose around.
PROSE = "the of and for with from report market water history people system national government development international information university production environment research community performance understanding throughout".split()
_LOWER, _HEX, _ALNUM = string.ascii_lowercase, "0123456789abcdef", string.ascii_letters + string.digits


def _drawn(letters: str, least: int, most: int | None = None):
    return lambda r: "".join(r.choice(letters) for _ in range(r.randint(least, most or least)))


def _syllables(least: int, most: int):
    return lambda r: "".join(r.choice("bcdfglmnprstv") + r.choice("aeiou") + r.choice(["", "n", "r", "s", "th"]) for _ in range(r.randint(least, most)))


def _uuid(r: random.Random) -> str:
    return "-".join("".join(r.choice(_HEX) for _ in range(n)) for n in (8, 4, 4, 4, 12))


def _phrase(r: random.Random) -> str:
    return "".join(_syllables(2, 2)(r) for _ in range(r.randint(3, 5)))


def _mixed(r: random.Random) -> str:
    return _syllables(2, 4)(r).title() + _drawn(string.digits, 2, 5)(r)


def _joined(r: random.Random) -> str:
    return r.choice("-_").join(r.choice(PROSE) for _ in range(r.randint(2, 4)))


#: (line with {} for the value, its generator, label).
TEMPLATES = (
    ("aws_access_key_id = {}", lambda r: "AKIA" + _drawn(string.ascii_uppercase + string.digits, 16)(r), 1),
    ("key {} was found in the log", lambda r: "AKIA" + _drawn(string.ascii_uppercase + string.digits, 16)(r), 1),
    ("aws_secret_access_key={}", _drawn(_ALNUM + "+/", 40), 1),
    ("git clone with {} as user", lambda r: "ghp_" + _drawn(_ALNUM, 36)(r), 1),
    ("OPENAI={}", lambda r: "sk-" + _drawn(_ALNUM, 32, 48)(r), 1),
    ("slack: {}", lambda r: "xoxb-" + _drawn(string.digits, 12)(r) + "-" + _drawn(_ALNUM, 24)(r), 1),
    ('token = "{}"', _drawn(_HEX, 32, 40), 1),
    ("token: {}", _drawn(_ALNUM, 20, 60), 1),
    ("token={}", _drawn(_ALNUM + "-_", 200, 700), 1),
    ('{{"user":"admin","password":"{}"}}', _drawn(_LOWER + string.digits, 12, 20), 1),
    ('{{"password":"abcd12","api_key":"{}"}}', _drawn(_LOWER + string.digits, 16, 32), 1),
    ("password={}", _phrase, 1),
    ("passwd: {}", _mixed, 1),
    ("my password: {} please keep it", _mixed, 1),
    ("secret = '{}'", _phrase, 1),
    ("client_secret={}", _uuid, 1),
    ("Authorization: Bearer {}", _drawn(_ALNUM + "-_", 40, 120), 1),
    ("api-key: {}", _drawn(_ALNUM, 24, 40), 1),
    ("private_key={}", _drawn(_ALNUM + "+/", 120, 900), 1),
    ("postgres://app:{}@db.internal/main", _drawn(_ALNUM, 10, 20), 1),
    ("{}", _syllables(3, 5), 0),
    ("{}", _syllables(4, 7), 0),
    ("{}", lambda r: _syllables(3, 5)(r).title(), 0),
    ("{}", lambda r: r.choice([w for w in PROSE if len(w) > 7]), 0),
    ("{}", _joined, 0),
    ("name = {}", _syllables(3, 5), 0),
    ("title: {}", _joined, 0),
    ("the secret {} of it", _syllables(3, 5), 0),
    ("a token {} of thanks", _syllables(3, 5), 0),
    ("forgot the password. {} again", _syllables(3, 5), 0),
    ("reset_password({})", lambda r: r.choice(["request", "account"]) + "_" + r.choice(PROSE), 0),
    ("{} = load()", lambda r: r.choice(["password", "api_key", "secret"]) + "_" + r.choice(PROSE), 0),
    ("password: {}", lambda r: r.choice(["changeme", "your-password-here", "placeholder", "example-password"]), 0),
    ("token = {}", lambda r: r.choice(["your-token-here", "example-token", "xxxxxxxxxxxx", "placeholder"]), 0),
    ("commit {}", _drawn(_HEX, 40), 0),
    ("sha256: {}", _drawn(_HEX, 64), 0),
    ("md5 checksum {} ok", _drawn(_HEX, 32), 0),
    ("uuid = {}", _uuid, 0),
    ("id {} done", _uuid, 0),
    ("order {} shipped", _drawn(string.digits, 8, 16), 0),
    ("call {} now", lambda r: "+" + _drawn(string.digits, 10, 13)(r), 0),
    ("card {} here", _drawn(string.digits, 16), 0),
    ("count = {}", _drawn(string.digits, 8, 12), 0),
    ("on {} at noon", lambda r: f"{r.randint(1950, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", 0),
    ("see https://site.example.{}", lambda r: "com" + "".join("/" + r.choice(PROSE) for _ in range(3)), 0),
    ("at {} there", lambda r: "".join("/" + _syllables(2, 3)(r) for _ in range(4)), 0),
    ("mail {}@mail.example.com", lambda r: _syllables(2, 3)(r) + "92", 0),
    ("mail user.{}@mail.example.com", _syllables(3, 4), 0),
    ("version {} of it", lambda r: f"release-{r.randint(1, 99)}-{r.randint(1, 99)}", 0),
    ("| {} |", lambda r: r.choice("-+_/") * r.randint(8, 80), 0),
)


def samples() -> list[tuple[str, str, int, int]]:
    """(text, path, start of the value in it, label) of EACH findings a template."""
    r = random.Random(SEED)
    out = []
    for line, value, label in TEMPLATES:
        for _ in range(EACH):
            prose = lambda: " ".join(r.choice(PROSE) if r.random() < 0.6 else _syllables(1, 4)(r) for _ in range(r.randint(0, 6)))  # noqa: E731, B023
            v = value(r)
            while len(v) < 8:
                v = value(r)
            before, after = line.split("{}")
            start = f"{prose()}{r.choice([' ', chr(10)])}{before}".replace("{{", "{").replace("}}", "}")
            text = f"{start}{v}{after}{r.choice([' ', chr(10)])}{prose()}".replace("}}", "}")
            out.append((text, r.choice(["src/app.py", "conf/settings.ini", "src3", "notes", "web"]), len(start), label))
    return out
