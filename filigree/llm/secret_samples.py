"""Labelled lines for the secret scan: real keys, tokens and passwords, and what is easily taken for them.

Everything is made by chance from a seed and some words of the corpus. A line is (text, secret); secret is null where the line has none.
Names and labels are independent of each other as far as they are in practice: secrets stand with and without
names, and there are values behind secret-sounding names that are none.
"""

from __future__ import annotations

import random
import string

HEX, LOWER, DIGITS = "0123456789abcdef", string.ascii_lowercase, string.digits
BASE = string.ascii_letters + DIGITS
SYLLABLES = "ba ce di fo gu ka le mi no pu ra se ti vo wa ze lon mar ter sin dal rek tom vil".split()
FILLER = "the of and to in for on with at from by this that it is was as be are or not all one new can has more its our they".split()
SECRET_NAMES = (
    "token secret password passwd pwd pass api_key apikey api-key access_token auth_token accessToken apiKey client_secret clientSecret secret_key private_key "
    "db_password DB_PASSWORD API_KEY AUTH_TOKEN refresh_token bearer credential passphrase webhook_secret signing_key encryption_key session_secret ssh_key TOKEN SECRET PASSWORD"
).split()
PLAIN_NAMES = (
    "id uuid request_id trace_id commit revision sha sha256 md5 checksum digest etag version build release image order invoice ref session_id user_id file path "
    "hash fingerprint serial model date time host url color width size sku isbn phone account number card name title label category event"
).split()
#: Settings whose names only sound secret.
SOUNDING = (
    "max_tokens token_count tokens_used token_type token_url token_limit password_policy password_min_length password_changed secret_version secret_name auth_url auth_method "
    "auth_provider authorId author key_id key_name keyboard public_key_id passenger password_hint token_expiry api_version secret_count credential_type access_level private_beta"
).split()
PLACEHOLDERS = (
    "changeme your_password_here ${DB_PASSWORD} xxxxxxxxxxxx ******** <password> REPLACE_ME example placeholder null undefined your-api-key os.environ $TOKEN {{token}} TODO "
    "insert_token_here redacted None required optional password string"
).split()


class Maker:
    def __init__(self, seed: int, vocabulary: list[str]):
        self.rng, self.vocabulary = random.Random(seed), vocabulary

    def chars(self, letters: str, n: int) -> str:
        return "".join(self.rng.choices(letters, k=n))

    def word(self, low: int = 1, high: int = 4) -> str:
        """A word of the corpus, or so many syllables in a row."""
        if self.vocabulary and self.rng.random() < 0.7:
            return self.rng.choice(self.vocabulary)
        return "".join(self.rng.choices(SYLLABLES, k=self.rng.randint(low, high)))

    def words(self, low: int, high: int) -> str:
        pick = lambda: self.rng.choice(FILLER) if self.rng.random() < 0.4 else self.word()
        return " ".join(pick() for _ in range(self.rng.randint(low, high)))

    def assigned(self, name: str, value: str) -> str:
        shape = self.rng.choice(['{n} = "{v}"', "{n}={v}", '"{n}": "{v}"', "{n}: {v}", '{{"{n}":"{v}","n":1}}', "{n} = '{v}'", "export {n}={v}", "--{n}={v}", "?{n}={v}&lang=en", "{n} is: {v}"])
        return shape.format(n=self.rng.choice([name, name, name.upper()]), v=value)

    def digest(self) -> str:
        out = self.chars(HEX, self.rng.choice([32, 40, 40, 64]))
        return out.upper() if self.rng.random() < 0.15 else out

    def uuid(self) -> str:
        return "-".join(self.chars(HEX, k) for k in (8, 4, 4, 4, 12))

    def issued(self) -> str:
        return self.rng.choice([
            lambda: "AKIA" + self.chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), lambda: f"gh{self.rng.choice('pousr')}_" + self.chars(BASE, 36),
            lambda: f"xox{self.rng.choice('bp')}-{self.chars(DIGITS, 11)}-{self.chars(DIGITS, 12)}-{self.chars(BASE, 24)}", lambda: f"sk_{self.rng.choice(['live', 'test'])}_" + self.chars(BASE, 24),
            lambda: "AIza" + self.chars(BASE + "-_", 35), lambda: "glpat-" + self.chars(BASE, 20), lambda: "eyJ" + self.chars(BASE, self.rng.randint(20, 60)),
        ])()

    def key(self) -> str:
        n = self.rng.choice([20, 24, 32, 40, 43, 44, 64])
        return self.chars(BASE + "+/" if self.rng.random() < 0.3 else BASE, n) + self.rng.choice(["", "", "", "=", "=="])

    def password(self) -> str:
        w = self.word(1, 3)
        kind = self.rng.randrange(5)
        if kind == 0:
            return self.rng.choice([w, w.capitalize()]) + self.chars(DIGITS, self.rng.randint(2, 4))
        if kind == 1:
            return "".join({"a": "4", "e": "3", "o": "0", "i": "1"}.get(c, c) if self.rng.random() < 0.6 else c for c in w + self.word(1, 2)) + self.rng.choice("!@#$%*?") + self.chars(DIGITS, 2)
        if kind == 2:
            return self.chars(BASE + "!@#$%^*", self.rng.randint(8, 20))
        if kind == 3:
            return self.rng.choice(["", "", "-", "."]).join(self.word(2, 3) for _ in range(self.rng.randint(2, 4)))
        return w + self.rng.choice("!@#_.") + self.word(1, 2) + self.chars(DIGITS, self.rng.randint(1, 4))

    def real(self) -> tuple[str, str]:
        kind = self.rng.random()
        if kind < 0.3:
            v = self.rng.choice([self.digest, self.key, self.key, self.issued])()
            return self.assigned(self.rng.choice(SECRET_NAMES), v), v
        if kind < 0.55:
            v = self.password()
            return self.assigned(self.rng.choice([n for n in SECRET_NAMES if "pass" in n.lower() or "pwd" in n or "secret" in n.lower()]), v), v
        if kind < 0.7:
            v = self.issued()
            return self.rng.choice(["{v}", "{v},", "({v})", "use {v} now", "https://a.example/x?y={v}", "https://{w}.example/{w}/{v}/{w}", "{n}={v}", "https://user:{v}@{w}.example/org/repo", "{v},{w}"]).format(v=v, n=self.rng.choice(PLAIN_NAMES), w=self.word()), v
        if kind < 0.85:
            v = self.key()
            return self.rng.choice(["{v}", '"{v}"', "ssh {v}", "login with {v}", "ssh-rsa {v}", "Authorization: Bearer {v}", "curl -u admin:{v}", "key {v}", "Basic {v}"]).format(v=v), v
        v = self.rng.choice([self.key, self.digest, self.password])()
        v = v if any(c.isdigit() for c in v) and len(v) >= 8 else v + self.chars(DIGITS, 8)
        return self.rng.choice(["password {v}", "the password is: {v}", "secret {v}", "token {v}", "my passphrase: {v}", "pwd {v}", "credentials: {v}", "login: root password: {v}"]).format(v=v), v

    def decoy(self) -> str:
        plain, w = self.rng.choice(PLAIN_NAMES), self.word
        value = self.rng.choice([
            self.uuid, self.digest, lambda: self.chars(DIGITS, self.rng.randint(8, 16)), lambda: f"{self.rng.randint(0, 9)}.{self.rng.randint(0, 30)}.{self.rng.randint(0, 9)}-beta{self.rng.randint(1, 9)}",
            lambda: f"{w()}-{self.chars(DIGITS, 6)}", lambda: f"20{self.chars('0123', 2)}-0{self.chars('123456789', 1)}-1{self.chars(DIGITS, 1)}T10:{self.chars('012345', 1)}0:00Z", lambda: w(1, 2) + w().capitalize() + w().capitalize(),
            lambda: f"{w()}_{w()}_{self.rng.randint(1, 99)}", lambda: f"https://{w()}.example.com/{w()}/{self.rng.randint(1, 9999)}", lambda: f"/usr/{w()}/{w()}{self.rng.randint(1, 9)}/{w()}.so.{self.rng.randint(1, 9)}",
            lambda: f"{w()}@mail{self.rng.randint(1, 99)}.example.com", w, lambda: f"{self.rng.choice('0123456789')}x{self.chars(HEX, 8)}",
        ])
        kind = self.rng.random()
        if kind < 0.4:
            return self.assigned(plain, value())
        if kind < 0.55:
            number = lambda: str(self.rng.randint(1, 99999))
            return self.assigned(self.rng.choice(SOUNDING), self.rng.choice([number, number, w, value, lambda: f"v{self.rng.randint(1, 9)}.{self.rng.randint(0, 99)}"])())
        if kind < 0.67:
            return self.assigned(self.rng.choice(SECRET_NAMES), self.rng.choice(PLACEHOLDERS))
        if kind < 0.9:
            return self.rng.choice(["{v}", '"{v}"', "see {v}", "commit {v}", "sha256:{v}", "at {v}:", "/assets/{w}.{h}.js", "/{w}/{h}/{w}.png", "order {v}", "card {v}", "call {v}", "in {v},", "run {v}", "file {v}", "objects/{h}"]).format(v=value(), w=w(), h=self.chars(HEX, self.rng.choice([8, 16, 40])))
        return self.rng.choice(["{a}: {b}", "{a}={b}", "note: {b}", "Warning: {b}", "{a} {b}"]).format(a=w(), b=w(2, 4))


def sample_lines(n: int, vocabulary: list[str] = (), seed: int = 11) -> list[tuple[str, str | None]]:
    """``n`` lines, half of them with a secret, that speak with the words of ``vocabulary`` too."""
    make, out = Maker(seed, list(vocabulary)), []
    for k in range(n):
        text, secret = make.real() if k % 2 else (make.decoy(), None)
        out.append((f"{make.words(0, 6)} {text}{make.rng.choice(['', '', '###', '!!', '.'])} {make.words(0, 4)}".strip(), secret))
    return out
