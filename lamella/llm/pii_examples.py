"""Made-up labelled texts for the candidates of `pii`: personal data of many formats and look-alikes, with and without cue words."""

from __future__ import annotations

import random

SYLLABLES = "an er on tion le re en che lich ver os ado ment eau ing st ou ha ti sch ien que il bo ra mi".split()
FIRST, HOSTS, ENDS = "anna jose marie peter lucia tom eva karl ines otto".split(), "example mailbox firma correo posta office".split(), "com org net de fr es io co.uk".split()
CUES = {
    "local_phone": ("call me at ", "Tel. ", "phone: ", "Mobile: ", "Téléphone : ", "rufen Sie an: ", "llame al ", "fax ", "my number is ", "Handy ", "reach us on ", "appelez le "),
    "email_words": ("mail ", "write to ", "contact: ", "E-Mail: ", "écrivez à ", "escriba a ", "Kontakt ", "email me: "),
    "iban": ("IBAN ", "account ", "Konto: ", "compte ", "cuenta ", "transfer to ", "bank: "),
    "card_part": ("card ", "visa ", "Karte: ", "carte ", "tarjeta ", "credit card no ", "cards "),
    "national_id": ("SSN ", "social security number ", "SSN: ", "passport ", "identity no ", "national id "),
    "ip6": ("IP ", "host ", "from ", "server ", "Adresse IP : ", "ping "),
}
WRONG = ("order ", "invoice no. ", "page ", "version ", "ISBN ", "part no. ", "serial ", "ticket #", "ref. ", "section ", "model ", "Bestellung ", "commande ", "pedido ", "score ", "total ", "build ", "item ", "chapter ")


def _luhn_end(digits: str) -> str:
    total = sum((2 * d - 9 * (d > 4)) if k % 2 == 0 else d for k, d in enumerate(map(int, reversed(digits))))
    return digits + str(-total % 10)


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(self.r.choices("0123456789", k=n))

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4))) for _ in range(self.r.randint(low, high)))

    def card(self) -> str:
        return _luhn_end(self.r.choice("3456") + self.digits(14))

    def local_phone(self) -> tuple[str, bool]:
        """A number without a country code, and whether its format alone tells it."""
        r, d = self.r, self.digits
        area = str(r.randint(2, 9)) + d(2)
        return r.choice([
            (f"({area}) {d(3)}-{d(4)}", True), (f"({area}) {d(3)} {d(4)}", True), (f"{area}-{d(3)}-{d(4)}", True), (f"{area}.{d(3)}.{d(4)}", True), (f"({area}){d(3)}-{d(4)}", True),
            (f"0{r.randint(1, 7)} {d(2)} {d(2)} {d(2)} {d(2)}", True), (f"0{r.randint(1, 7)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", True),
            (f"0{d(2)} {d(7)}", False), (f"0{d(3)}/{d(6)}", False), (f"0{d(3)} {d(3)} {d(4)}", False), (f"{area} {d(3)} {d(4)}", False), (f"0{d(2)}-{d(8)}", False), (f"{r.randint(6, 9)}{d(2)} {d(2)} {d(2)} {d(2)}", False),
        ])

    def email_words(self) -> tuple[str, bool]:
        r = self.r
        name = r.choice(FIRST) + r.choice(["", ".", "_"]) + r.choice([self.digits(2), r.choice(SYLLABLES), r.choice(FIRST)])
        host, end = r.choice(HOSTS) + r.choice(["", self.digits(1)]), r.choice(ENDS)
        at, dot = r.choice([(" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), ("[at]", "."), (" at ", " dot "), (" AT ", " DOT "), ("(at)", "(dot)"), (" {at} ", " {dot} "), (" (at) ", " (punkt) "), (" arroba ", " punto "), (" (@) ", ".")])
        return f"{name}{at}{host}{dot}{end.replace('.', dot)}", True

    def iban(self) -> tuple[str, bool]:
        land, n = self.r.choice([("DE", 18), ("ES", 20), ("FR", 23), ("NL", 14), ("AT", 16), ("GB", 18)])
        body = ("ABNA" if land in ("NL", "GB") else "") + self.digits(n - 4 * (land in ("NL", "GB")))
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        run = f"{land}{check:02}{body}"
        return (run if self.r.random() < 0.5 else " ".join(run[i : i + 4] for i in range(0, len(run), 4))), True

    def national_id(self) -> tuple[str, bool]:
        d, r = self.digits, self.r
        return r.choice([(f"{r.randint(100, 665)}-{r.randint(10, 99)}-{d(4)}", True), (f"{r.randint(100, 665)} {r.randint(10, 99)} {d(4)}", False)])

    def ip6(self) -> tuple[str, bool]:
        hexed = lambda: f"{self.r.randrange(1 << 16):x}"
        full = ":".join(["2001", *(hexed() for _ in range(7))])
        short = f"{self.r.choice(['2001', 'fe80', '2a02', 'fd12'])}:{hexed()}::{hexed()}:{hexed()}"
        return self.r.choice([full, short, f"fe80::{hexed()}:{hexed()}:{hexed()}"]), True

    def lookalike(self) -> str:
        r, d = self.r, self.digits
        wrong = r.choice(WRONG)
        year = str(r.randint(1900, 2030))
        return r.choice([
            f"{year}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(1, 28):02}.{r.randint(1, 12):02}.{year}", f"{r.randint(1, 12)}/{r.randint(1, 28)}/{year}", f"{year}-{int(year) + r.randint(1, 9)}", f"{year}/{d(2)}/{d(2)} {d(2)}:{d(2)}:{d(2)}",
            f"{wrong}{d(3)}-{d(3)}-{d(4)}", f"{wrong}{d(3)} {d(3)} {d(4)}", f"{wrong}{d(3)}-{d(2)}-{d(4)}", f"{wrong}{d(2)} {d(2)} {d(2)} {d(2)}", f"{wrong}{d(4)}.{d(4)}", f"{wrong}{d(5)}-{d(5)}",
            f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"pages {d(3)}-{d(3)} {d(4)}", f"{d(3)} {d(3)} {d(3)}", f"{d(1)} {d(3)} {d(3)}.{d(2)} €", f"{d(3)}.{d(3)}.{d(3)}", f"{d(2)}.{d(2)}.{d(2)}.{d(3)}", f"{r.randint(256, 999)}.{d(3)}.{d(2)}.{d(3)}", f"{r.randint(1, 9)}.{d(2)}.{d(2)}.{d(4)}",
            f"{d(4)} {d(4)}", f"{d(2)} {d(3)} {d(4)}", f"{d(1)} {d(2)} {d(3)} {d(4)}", f"{d(5)} {d(5)}", f"{d(2)}-{d(2)} {d(2)}-{d(2)} {d(2)}-{d(2)}", f"${d(3)} {d(3)} {d(3)}", f"{d(3)}-{d(4)} kg",
            d(16), d(16), f"{d(16)} {d(16)}", f"{d(13)}", f"{d(8)} {d(8)}", f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}-{d(4)}",
            f"{d(2)}:{d(2)}:{d(2)}", ":".join(f"{r.randrange(256):02x}" for _ in range(6)), f"{d(1)}:{d(1)}:{d(2)}", "a::b", "abc::def::fee", f"{d(2)}:{d(2)}::{d(2)}",
            r.choice(["AB", "DE", "FR", "XK"]) + d(r.randint(13, 22)), r.choice(["ISO", "DIN"]) + f" {d(4)} {d(4)}",
            f"look at {r.choice(HOSTS)}.{r.choice(ENDS)}", f"{r.choice(FIRST)} at {r.choice(HOSTS)} point {r.choice(FIRST)}", f"meet at noon dot {r.choice(FIRST)}", f"{r.choice(FIRST)} arrived at {r.choice(HOSTS)}.{r.choice(ENDS)}", f"f(at) x.{d(2)}",
        ])


KINDS = ("local_phone", "email_words", "iban", "card_part", "national_id", "ip6")


def examples(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """n texts, each with the spans (code points, ends exclusive, kinds) of its personal data that no plain pattern finds; about half have one."""
    m, out = Maker(seed), []
    for _ in range(n):
        r, text, spans = m.r, m.words(2, 9) + " ", []
        if r.random() < 0.5:
            kind = r.choice(KINDS)
            if kind == "card_part":
                held, others = [m.card(), m.card()], [m.digits(16), m.card()]
                parts = r.choice([held, held, [m.card(), m.digits(r.randint(5, 16))], [m.digits(r.randint(5, 16)), m.card()], others])
                text += r.choice(CUES[kind]) if r.random() < 0.5 else ""
                for i, p in enumerate(parts):
                    if len(p) == 16 and _luhn_end(p[:-1]) == p:
                        spans.append((len(text), len(text) + 16, kind))
                    text += p + (r.choice(" -") if i == 0 else "")
            else:
                value, plain = getattr(m, kind)()
                if plain and r.random() < 0.5:
                    pass
                elif not plain and r.random() < 0.25:  # nothing tells such a number from others
                    text += r.choice(WRONG)
                    kind = None
                else:
                    text += r.choice(CUES[kind])
                if kind:
                    spans.append((len(text), len(text) + len(value), kind))
                text += value
        else:
            text += (r.choice(r.choice(list(CUES.values()))) if r.random() < 0.1 else "") + m.lookalike()
        out.append((text + r.choice([" ", ". ", ", ", "; ", "\n", "*** ", "!! ", ": "]) + m.words(1, 8), spans))
    return out
