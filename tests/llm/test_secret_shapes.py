"""Secrets and look-alikes written apart from the generator that trains the network: recall and false alarms by shape."""

import base64
import random
import string
import uuid

import pytest

from quernstone.llm import secrets

R = random.Random(20)
ALNUM = string.ascii_letters + string.digits
NOUNS = "river anchor copper velvet marble candle harbor meadow falcon thunder pepper garden window silver basket".split()
SAYING = "We deployed the new build yesterday and it broke.|Please ask the operations team before you change this.|Die Anlage läuft seit Montag ohne Störung.|la configuration se trouve dans le fichier suivant".split("|")


def chars(alphabet, n):
    return "".join(R.choice(alphabet) for _ in range(n))


def mixed(n):
    while True:
        x = chars(ALNUM, n)
        if any(c.isdigit() for c in x) and any(c.isupper() for c in x) and any(c.islower() for c in x):
            return x


SECRETS = {
    "secret token": lambda: ("the secret token: ", mixed(24), "."),
    "told twice": lambda: ("password is password: ", R.choice(NOUNS) + chars(string.digits, 3), " ok"),
    "bearer": lambda: ("Authorization: Bearer ", mixed(32), "\nAccept: */*"),
    "connection": lambda: (R.choice(["postgres", "mysql", "amqp"]) + "://admin:", mixed(14), "@db1.internal:5432/main"),
    "api header": lambda: ("X-Api-Key: ", str(uuid.UUID(int=R.getrandbits(128))), "\n"),
    "ssh password": lambda: ("the ssh password is ", R.choice(NOUNS).capitalize() + R.choice("!#$%") + chars(string.digits, 3), " today"),
    "github": lambda: ("push with ", "ghp_" + mixed(36), " now"),
    "stripe": lambda: ("key ", "sk_live_" + mixed(24), ", careful"),
    "slack": lambda: ("bot ", f"xoxb-{chars(string.digits, 11)}-{chars(string.digits, 12)}-{mixed(24)}", " joined"),
    "jwt": lambda: ("cookie ", f"eyJ{mixed(17)}.eyJ{mixed(40)}.{mixed(43)}", ";"),
    "cloud": lambda: ("aws_secret_access_key = ", chars(ALNUM + "+/", 40), "\n"),
    "pass phrase": lambda: ("passphrase: ", "-".join(R.sample(NOUNS, 4)), "\n"),
    "quoted": lambda: ("pwd = '", mixed(10) + "!", "'"),
    "client secret": lambda: ("client_secret is ", mixed(11), " for now"),
    "bare": lambda: ("left in the log: ", mixed(40), " at noon"),
}
OTHERS = {
    "camel case": lambda: f"get{R.choice(NOUNS).title()}{R.choice(NOUNS).title()}ById{chars(string.digits, 2)}FromCache",
    "part number": lambda: f"{chars(string.ascii_uppercase, 3)}-{chars(string.digits, 5)}-{chars(string.ascii_uppercase, 5)}-{chars(string.digits, 5)}",
    "data": lambda: "data:image/png;base64," + base64.b64encode(R.randbytes(90)).decode(),
    "gene": lambda: "ENSG" + chars(string.digits, 11),
    "uuid": lambda: "request " + str(uuid.UUID(int=R.getrandbits(128))),
    "video": lambda: "https://www.tube.example/watch?v=" + chars(ALNUM + "_-", 11),
    "mail": lambda: f"{R.choice(NOUNS)}.{R.choice(NOUNS)}{chars(string.digits, 2)}@{R.choice(NOUNS)}.example.com",
    "path": lambda: f"/usr/share/{R.choice(NOUNS)}/{R.choice(NOUNS)}-{chars(string.digits, 1)}.{chars(string.digits, 2)}/index{chars(string.digits, 2)}.html",
    "date": lambda: f"2024-0{R.randint(1, 9)}-1{R.randint(0, 9)}T0{R.randint(0, 9)}:4{R.randint(0, 9)}:00.{chars(string.digits, 3)}Z",
    "plain after a word": lambda: "the password must be changed every month, the token expires, a secret garden",
}


def embedded(middle):
    return f"{R.choice(SAYING)} ", middle, f" {R.choice(SAYING)}"


@pytest.mark.parametrize("shape", sorted(SECRETS))
def test_recall(shape):
    m, found = secrets.model(), 0
    R.seed(shape)
    for _ in range(60):
        before, secret, after = SECRETS[shape]()
        lead, _, tail = embedded("")
        text = lead + before + secret + after + tail
        s = len(lead) + len(before)
        # found as a whole: nothing of it stays when findings are cut out
        cover = {i for a, _, b in m.findings(text)[1] for i in range(a, b)}
        found += cover >= set(range(s, s + len(secret.rstrip("!"))))
    assert found >= 54


@pytest.mark.parametrize("shape", sorted(OTHERS))
def test_false_alarms(shape):
    m, said = secrets.model(), 0
    R.seed(shape)
    for _ in range(100):
        said += any(k == 3 for _, k, _ in m.findings("".join(embedded(OTHERS[shape]())))[1])
    assert said < 5


def test_every_giving_word_counts():
    seen = lambda t: [t[s:e] for s, e in secrets.candidates(t, secrets.base_findings(t))]
    assert seen("the secret token: abcdefg1") == ["abcdefg1"]
    assert seen("password is password: hunter22") == ["hunter22"]
    assert seen("Authorization: Bearer abcdefg1") == ["abcdefg1"]
    assert seen("redis://u:hunter2x@cache:6379/0") == ["hunter2x"]
    assert seen("data:font/woff;base64,d09GMgABAAAAAB9gAA4AAAAAPjQAAB8JAAEAAAAA") == []


def test_candidates_take_linear_time():
    import time

    took = []
    for n in (20_000, 80_000):
        for piece in ("token:", "password is ", "://a:", "secret=", "bearer "):
            start = time.perf_counter()
            secrets.candidates(piece * (n // len(piece)), [])
            took.append(time.perf_counter() - start)
    assert all(b < 12 * a + 0.2 for a, b in zip(took[:5], took[5:], strict=True))
