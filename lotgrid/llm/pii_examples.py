"""Texts with one candidate for personal data each, and what of it is to be found; made up, as the tables hold no labels.

Positives and negatives share formats; they differ by check digits, by what stands around them, or by their make-up. Held-out
examples take other words around the candidates than those that are learned from.
"""

from __future__ import annotations

import random
import string

#: (words learned from, words held out) that may stand before a candidate of each kind.
HINTS = {
    "phone": (["phone", "tel", "Tel.:", "call", "mobile:", "cell", "fax", "my number is", "ring", "dial", "telefon", "WhatsApp", "teléfono", "call me on", "phone no."], ["reach me on", "my tel", "telephone:", "sms", "hotline", "handy", "text me at", "please contact", "móvil", "téléphone"]),
    "email": (["mail", "write to", "contact:", "e-mail", "send it to"], ["email me:", "reach me at", "courriel", "reply to"]),
    "ip": (["host", "ip", "from server", "client address", "connected to"], ["gateway", "peer", "login from", "IPv6:"]),
    "card": (["card", "visa", "pay with", "credit card:", "account", "mastercard no", "carte", "charged to card"], ["card number", "amex", "debit card", "tarjeta", "paid by"]),
    "secret": (["token =", "api_key:", "password =", "secret:", "SECRET_KEY=", "Bearer", "access token", "key ="], ["auth token:", "apikey =", "passwd:", "client_secret =", "credentials:", "private key"]),
    "id": (["SSN", "social security number", "passport", "IBAN", "account", "tax id", "DNI"], ["ssn:", "insurance no.", "identity card", "bank account", "konto"]),
}
OTHERS = (
    ["order", "order no.", "invoice", "ISBN", "serial", "ref.", "tracking", "part", "page", "version", "commit", "sha256:", "row", "parcel", "date", "article", "image", "score", "total", "line", "lot", "md5"],
    ["order id", "item no.", "sku", "build", "checksum", "ean", "batch", "revision", "case", "digest", "file", "table", "etag", "result"],
)
_SYLLABLES = "an be ci da el fo gu ha in jo ka le mi no or pe qu ra se ti un ve wo xi yo ze ing tion ment eau sch ung ado ción é ü".split()
_COMMON = "the of and to in is was for with de la le und der die en el que et un per at by from".split()
_DIGITS, _HEX, _MIXED = string.digits, "0123456789abcdef", string.ascii_letters + string.digits


class _Maker:
    def __init__(self, seed: int, held: bool):
        self.rng, self.held = random.Random(seed), held

    def pick(self, of):
        return self.rng.choice(of)

    def chars(self, alphabet: str, n: int) -> str:
        return "".join(self.rng.choice(alphabet) for _ in range(n))

    def num(self, n: int) -> str:
        return str(self.rng.randint(1, 9)) + self.chars(_DIGITS, n - 1)

    def word(self) -> str:
        if self.rng.random() < 0.25:
            return self.pick(_COMMON)
        return "".join(self.pick(_SYLLABLES) for _ in range(self.rng.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def luhn(self, n: int, ok: bool) -> str:
        d = self.pick("3456") + self.chars(_DIGITS, n - 2)
        total = sum((2 * int(c) - 9 * (int(c) > 4)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(d)))
        last = (10 - total % 10) % 10
        return d + str(last if ok else (last + self.rng.randint(1, 9)) % 10)

    def grouped(self, digits: str, sizes: tuple[int, ...], sep: str) -> str:
        out, at = [], 0
        for n in sizes:
            out.append(digits[at : at + n])
            at += n
        return sep.join(out)

    # what is to be found

    def phone(self) -> str:
        sep, r = self.pick(" -. "), self.rng.random()
        if r < 0.3:
            area = self.pick(["({})", "({}) ", "{}" + sep, "{}" + sep]).format(self.num(3))
            return f"{area}{self.num(3)}{self.pick('-. ') if sep == ' ' else sep}{self.chars(_DIGITS, 4)}"
        if r < 0.55:
            return self.grouped("0" + self.num(10), self.pick([(3, 4, 4), (5, 3, 3), (4, 3, 4), (5, 6)]), sep) if self.rng.random() < 0.7 else f"(0{self.num(2)}) {self.num(4)} {self.num(4)}"
        if r < 0.7:
            return self.grouped("0" + self.num(9), self.pick([(2, 2, 2, 2, 2), (3, 3, 4), (4, 2, 2, 2)]), sep)
        if r < 0.85:
            return f"00{self.pick(['', ' '])}{self.rng.randint(30, 49)}{sep}{self.pick([self.num(2) + sep + self.num(4) + sep + self.num(4), self.num(3) + sep + self.num(6), self.num(9)])}"
        return "0" + self.num(self.rng.randint(9, 10)) if self.rng.random() < 0.7 else self.num(10)

    def email(self) -> str:
        a, d = self.pick([("[at]", "[dot]"), ("(at)", "(dot)"), ("{at}", "{dot}"), ("(at)", "."), ("[AT]", "[DOT]")])
        gap = self.pick(["", " "])
        return f"{self.word()}{self.pick(['', '.' + self.pick('abc'), self.num(2)])}{gap}{a}{gap}{self.pick('abcdefgh')}{self.num(2)}x{gap if d != '.' else ''}{d}{gap if d != '.' else ''}{self.pick(['com', 'org', 'de', 'example.com', 'fr'])}"

    def ip(self) -> str:
        group = lambda: f"{self.rng.randrange(65536):x}"
        if self.rng.random() < 0.5:
            return ":".join(group() for _ in range(8))
        return ":".join(["2001" if self.rng.random() < 0.5 else "fe80", *(group() for _ in range(self.rng.randint(0, 2)))]) + "::" + ":".join(group() for _ in range(self.rng.randint(1, 3)))

    def card(self) -> str:
        n = self.pick([16, 16, 16, 15, 13, 19])
        d = self.luhn(n, self.rng.random() < 0.5)
        return d if n != 16 or self.rng.random() < 0.5 else self.grouped(d, (4, 4, 4, 4), self.pick(" -./_"))

    def secret(self) -> str:
        r = self.rng.random()
        if r < 0.4:
            return self.chars(_HEX, self.pick([32, 40, 64])) if self.rng.random() < 0.8 else self.chars("0123456789ABCDEF", 40)
        if r < 0.55:
            return self.pick(["AKIA", "ASIA"]) + self.chars(string.ascii_uppercase + _DIGITS, 16) if self.rng.random() < 0.5 else self.pick(["ghp_", "sk_live_", "xoxb-", "eyJ"]) + self.chars(_MIXED, 36)
        return self.chars(_MIXED + ("+/" if r < 0.7 else "-_"), self.rng.randint(20, 64)) + self.pick(["", "", "="])

    def identity(self) -> str:
        if self.rng.random() < 0.5:
            return f"{self.num(3)}-{self.num(2)}-{self.num(4)}"
        d = self.pick(["DE", "FR", "ES", "GB", "NL"]) + self.num(2) + self.chars(_DIGITS, self.pick([16, 18, 20]))
        return d if self.rng.random() < 0.5 else self.grouped(d, (4,) * 6, " ").strip()

    # what looks like it

    def other(self) -> str:
        r = self.rng.randrange(19)
        sep = self.pick("-. ")
        return [
            lambda: f"{self.num(3)}{sep}{self.num(3)}{sep}{self.num(4)}",
            lambda: f"{self.rng.randint(1900, 2030)}-{self.rng.randint(1, 12):02}-{self.rng.randint(1, 28):02}" + self.pick(["", f" {self.rng.randint(10, 23)}:{self.rng.randint(10, 59)}"]),
            lambda: f"{self.rng.randint(1, 28):02}.{self.rng.randint(1, 12):02}.{self.rng.randint(1900, 2030)}",
            lambda: f"97{self.pick('89')}-{self.num(1)}-{self.num(4)}-{self.num(4)}-{self.num(1)}",
            lambda: self.num(self.rng.randint(9, 19)),
            lambda: self.num(self.rng.randint(1, 3)) + "0" * self.rng.randint(8, 12),
            lambda: f"{self.num(2)} {self.num(3)} {self.num(3)} {self.num(3)}",
            lambda: ":".join(f"{self.rng.randint(0, 59):02}" for _ in range(self.pick([2, 3, 6, 8]))),
            lambda: ":".join(self.chars(_HEX, 2) for _ in range(6)),
            lambda: self.chars(_HEX, self.pick([32, 40, 64])),
            lambda: f"{self.chars(_HEX, 8)}-{self.chars(_HEX, 4)}-{self.chars(_HEX, 4)}-{self.chars(_HEX, 4)}-{self.chars(_HEX, 12)}",
            lambda: f"{self.word()}_{self.word()}_{self.word()}{self.num(2)}_{self.word()}" + self.pick(["", "_" + self.num(4)]),
            lambda: f"/{self.word()}/{self.rng.randint(1990, 2030)}/{self.num(2)}/{self.word()}-{self.word()}-{self.word()}-{self.word()}",
            lambda: self.grouped(self.luhn(16, False), (4, 4, 4, 4), self.pick("-./_ ")),
            lambda: f"{self.num(3)}-{self.num(2)}-{self.num(4)}",
            lambda: f"{self.rng.randint(1900, 2030)}-{self.rng.randint(1900, 2030)}",
            lambda: f"{self.num(2)} {self.num(3)}",
            lambda: f"{self.num(3)} {self.num(2)}.{self.num(2)} {self.num(3)}",
            lambda: f"{self.num(4)}-{self.num(6)}",
        ][r]()

    def example(self) -> tuple[str, str, int, int]:
        head, tail = self.words(1, 8), self.words(1, 8)
        head, tail = (head.upper(), tail.upper()) if self.rng.random() < 0.1 else (head, tail)
        end, which = self.pick(["", "", "", ".", ",", "!!", "###", "%%%", ")", ";"]), int(self.held)
        if self.rng.random() < 0.5:
            kind = self.pick(["phone", "phone", "email", "ip", "card", "card", "secret", "secret", "id"])
            core = {"phone": self.phone, "email": self.email, "ip": self.ip, "card": self.card, "secret": self.secret, "id": self.identity}[kind]()
            bare = kind in ("email", "ip", "card") or kind == "phone" and len(core.strip(_DIGITS)) > 0 or kind == "id" and core[:2].isalpha() or kind == "secret" and not set(core.lower()) <= set(_HEX)
            lead = self.pick(HINTS[kind][which]) + " " if not bare or self.rng.random() < 0.6 else ""
            lead = lead.upper() if self.rng.random() < 0.1 else lead + self.pick(["", "", "", self.pick(["is ", "on ", "at ", "no "])])
        else:
            kind, core = "", self.other()
            lead = self.pick(OTHERS[which]) + self.pick([" ", " ", ": ", " #", " no "])
            if core[0] == "/" or core.count(":") in (1, 2, 5, 7) or core.count("_") > 2 and core[0].isalpha() or core[:2] in ("19", "20") and core[4:5] == "-" or core.endswith("0" * 8):
                lead = self.pick([lead, "", self.word() + " "])  # no candidate of any kind, whatever stands before it
        quote = self.pick(['"', "'"]) if kind == "secret" and self.rng.random() < 0.5 else ""
        at = len(f"{head} {lead}{quote}")
        return f"{head} {lead}{quote}{core}{quote}{end} {tail}", kind, at, at + len(core)


def example_texts(n: int, seed: int = 9, held: bool = False) -> list[tuple[str, str, int, int]]:
    """n texts with the kind ('' if none), start and end of what is to be found in each."""
    maker = _Maker(seed, held)
    return [maker.example() for _ in range(n)]
