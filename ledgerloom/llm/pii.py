"""Personal data: four exact patterns, and a linear-chain CRF that adds what no pattern describes.

The patterns find e-mail addresses, IPv4 addresses, payment cards and international phone numbers. The
CRF reads words through their shapes (character classes, length, edge punctuation) and a short list of
cue words, own and neighbouring, and adds spans of three further kinds: ``name``, ``address`` and
``contact`` (spelled-out mail addresses, local phone numbers). It is trained from the small labelled
table below, in four languages, and from sentences made by rule that hold nothing personal, and decoded
by Viterbi in numpy batches, one chain a sentence. Words that announce personal data count at a
distance of two words as well. A span must hold what its kind always has (``plausible``). Words are interned to shape
classes, so a token costs one dictionary lookup and three gathers. A sentence in which every token's
advantage for any other label is below what transitions could add back is all "outside"; that is a
proof, so such sentences skip the recursion and results stay those of Viterbi on all of them.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import crf
from .common import keeps, slices, thrifty

KINDS = ("email", "ip", "card", "phone")
ADDED = ("name", "address", "contact")
#: Words of more characters aren't kept in the memo.
LONG = 64
LABELS = ("O", *(f"{p}-{k}" for k in ADDED for p in "BI"))

# Where the given patterns would try every start of a run of digits, a look-behind keeps to the run's
# first: all starts of a run fail or succeed alike. Possessive repeats can't change a match here.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each "@": its local part is the run before it that no match has taken."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The pattern matches by kind as listed, then by start."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


# ---- the labelled table -------------------------------------------------------------------------

_FIRST = """Anna Peter Maria John Laura Thomas Elena James Sofia David Claire Lukas Marta Pierre Ingrid Carlos Helen Omar Julia Martin Emma Paul Nina
Robert Carla Hans Alice Miguel Sarah Jean Petra Antonio Lucy Karl Isabel Henri Grace Jorge Ruth Felix Amélie José Jürgen Noémie Íñigo Zoë""".split()
_LAST = """Schmidt Garcia Brown Dupont Rossi Miller Jensen Novak Lopez Keller Moreau Clark Weber Silva Young Fischer Martin Evans Torres Wagner
Taylor Hoffmann Bernard Gomez Walker Krause Petit Ruiz Cooper Vogel Leroy Ortega O'Brien Smith-Jones Müller Lefèvre Núñez Gröning Castañeda Da-Silva""".split()
_STREET = "Baker King Oak Mill Station Park Church Garden River Hill Queen Elm North Market Bridge Castle".split()
_WAY = "Street Road Avenue Lane Drive Boulevard St. Rd.".split()
_TOWN = "London Berlin Madrid Paris Boston Lyon Leeds Dublin Hamburg Sevilla Lille Köln Málaga Toronto".split()
_GERMAN = "Linden Haupt Garten Berg Schiller Bahnhof Mühlen Kirch Wald Ring Goethe Rosen".split()
_FRENCH = "Lilas Moulin Gare République Fleurs Château Paix Victoire Tilleuls Liberté".split()
_SPANISH = "Mayor Alcalá Sol Goya Serrano Real Cervantes Olmo Luna Toledo".split()
#: One row each: words, with the spans in brackets after their kind; capitals stand for drawn words.
TABLE = """
My name is name[FIRST LAST] and I teach history.
I am name[FIRST LAST], the new neighbour.
Please ask Mr. name[LAST] about the order.
Yesterday Mrs. name[FIRST LAST] signed the form.
The report was checked by Dr. name[LAST], as usual.
Prof. name[FIRST LAST] gave the lecture.
Contact name[FIRST LAST] for details.
Kind regards, name[FIRST LAST]
Sincerely, name[FIRST LAST]
Signed: name[FIRST LAST]
Patient name: name[FIRST LAST], born in spring.
Ms. name[FIRST LAST] will call back.
This letter was written by name[FIRST LAST] in winter.
Dear Mr. name[LAST], thank you for your letter.
Dear Mrs. name[FIRST LAST], we have received the parcel.
Customer: name[FIRST LAST]
My doctor is called name[FIRST LAST] and works in TOWN.
My sister's name is name[FIRST LAST], not Cap.
Mein Name ist name[FIRST LAST] und ich wohne hier.
Ich heiße name[FIRST LAST].
Herr name[LAST] ist heute nicht im Haus.
Bitte fragen Sie Frau name[FIRST LAST] danach.
Mit freundlichen Grüßen, name[FIRST LAST]
Ansprechpartner: name[FIRST LAST]
Sehr geehrter Herr name[LAST], vielen Dank für den Brief.
Unser Hausarzt Dr. name[FIRST LAST] hat Urlaub.
Je m'appelle name[FIRST LAST] et j'habite ici.
Mon nom est name[FIRST LAST].
Madame name[LAST] est absente aujourd'hui.
Monsieur name[FIRST LAST] a signé le contrat.
Cordialement, name[FIRST LAST]
Veuillez contacter name[FIRST LAST] pour la suite.
Chère Madame name[LAST], merci de votre lettre.
Me llamo name[FIRST LAST] y vivo aquí.
Mi nombre es name[FIRST LAST].
La señora name[LAST] no está en casa.
El señor name[FIRST LAST] firmó ayer.
Atentamente, name[FIRST LAST]
Pregunte por Sr. name[LAST] en la entrada.
Estimada Sra. name[FIRST LAST], gracias por su carta.
I live at address[NUM STREET WAY, TOWN] since May.
Send it to address[NUM STREET WAY] please.
The address is address[NUM STREET WAY, TOWN] as before.
Our office moved to address[NUM STREET WAY].
Deliver the parcel to address[NUM STREET WAY, TOWN].
Address: address[NUM STREET WAY]
She lives at address[NUM STREET WAY] with her dog.
Ich wohne in der address[GERMANstraße NUM] in TOWN.
Adresse: address[GERMANstraße NUM, ZIP TOWN]
Wir ziehen um in den address[GERMANweg NUM].
Schicken Sie es bitte an address[GERMANstraße NUM, ZIP TOWN].
J'habite au address[NUM rue de la FRENCH] depuis mai.
Adresse : address[NUM rue du FRENCH, TOWN]
Envoyez le colis au address[NUM avenue de la FRENCH].
Notre bureau est situé address[NUM boulevard du FRENCH].
Vivo en la address[calle SPANISH NUM] desde mayo.
Dirección: address[calle SPANISH NUM, TOWN]
Envíe el paquete a address[calle de SPANISH NUM].
La oficina está en address[avenida SPANISH NUM].
Write to contact[USER at HOST dot com] for help.
My mail is contact[USER (at) HOST (dot) org] these days.
Reach me under contact[USER at HOST dot net] anytime.
Email: contact[USER (at) HOST dot com]
Call contact[LOCAL] after six.
My phone number is contact[LOCAL] now.
You can call me at contact[LOCAL].
Tel: contact[(AREA) LOCAL] or by mail.
Phone contact[(AREA) LOCAL] today.
Rufen Sie mich an unter contact[0AREA/LONG] heute.
Telefon: contact[0AREA LONG]
Handy contact[0AREA LONG] nach sechs.
Meine Nummer ist contact[0AREA-LONG].
Schreiben Sie an contact[USER (at) HOST Punkt de] bitte.
Téléphone : contact[PAIR PAIR PAIR PAIR PAIR]
Appelez le contact[PAIR PAIR PAIR PAIR PAIR] ce soir.
Écrivez à contact[USER arobase HOST point fr] pour plus.
Teléfono: contact[AREA AREA AREA]
Llame al contact[AREA AREA AREA] por la tarde.
Mi correo es contact[USER arroba HOST punto es].
The quick plan was lower than what we had before.
The General Public Library opens its Reading Room at noon.
The Second Volume and the Third Edition were sold under the Open Trade Act.
St. Mary and St. Paul are two churches of TOWN.
Word and word, in the Other word of word.
The committee met in TOWN on Monday and adjourned in June.
The University of TOWN and the Royal Society published the study.
They read the New York Times and the Daily Post every day.
Old Town Hall and the Grand Hotel were closed on Sunday.
He spoke about World War and the Treaty of TOWN.
The North Sea and the Black Forest are popular in July.
Chapter NUM begins on page NUM of the Second Volume.
It is NUM of NUM words, and the Cap was word.
They met at noon and the dot was red.
Version NUM of the Cap word is out.
Call the word function NUM times.
The name of the river is word and the name of the hill is Cap.
Please send the word to the Cap word.
On the road to TOWN, the street was full.
The road was NUM miles long and NUM feet wide.
At NUM in the morning the station was empty.
In NUM the city had NUM shops and NUM schools.
The phone rang and nobody wanted to call back.
My address book was lost at the station.
I am sure that this is right.
Dear customers, the shop is closed on Friday.
Dear Sir or Madam, the offer ends today.
Kind regards from the whole team
Contact the office for details.
Email us or call the office on Monday.
Der Zug nach TOWN fährt um NUM Uhr ab.
Die Deutsche Bank und die Stadt TOWN planen ein neues Haus.
Am Montag war der Garten hinter dem Haus voller Blumen.
Die Straße war NUM Meter lang und sehr breit.
Der Name der Stadt ist alt, die Adresse des Museums neu.
Sehr geehrte Damen und Herren, das Amt bleibt geschlossen.
Das Haus in der Mitte hat NUM Zimmer und einen Keller.
Le train pour TOWN part à NUM heures.
La Banque de France et la ville de TOWN ont signé.
La rue était longue de NUM mètres et très calme.
Le nom de la rivière est ancien et son point de départ inconnu.
Madame, Monsieur, le bureau reste fermé lundi.
Le point de vue de la ville est connu.
El tren a TOWN sale a las NUM de la tarde.
El Banco de España y la ciudad de TOWN firmaron ayer.
La calle tenía NUM metros y era muy tranquila.
El nombre del río es antiguo y la dirección del viento cambia.
Muy señores míos, la oficina cierra el lunes.
CAP CAP CAP word CAP.
Cap word word the word. Cap cap word.
Word, Cap and Cap went word at word.
Cap word word Cap word Cap, word word.
Cap is the name that word gave.
Word IP word word MAIL word CARD word INTL word.
Cap MAIL Cap word INTL, word IP.
Cap Cap Cap Cap word word word word Cap Cap
Cap Cap word Cap, Cap word Cap Cap Cap word
Cap | word | Cap Cap | word | Cap word | NUM
Cap, Cap Cap word. Cap Cap: word word Cap.
word Cap NUM word, NUM Cap word NUM. NUM
word. NUM Cap Cap word at. NUM word, Cap
key word CODE word NUM, NUM word, NUM Cap. NUM
Cap word at word, word. To the word. By word and.
Word word. De la Cap que word. Und Cap word.
Der Cap word die Cap und Cap word das Cap.
La Cap de word et le Cap word au Cap.
El Cap de word y la Cap word en Cap.
Cap Cap Cap
Cap Cap
word word to word for in word at word by word word
word to it at word, word is word. At word the at word.
at word dot word the dot com point word punto word
""".strip().splitlines()  # fmt: skip
_ENDING = re.compile(r"(name|address|contact)\[([^\]]*)\]")


def _made_up(rng: random.Random) -> str:
    parts = "the an er on re in ou st ha nd ed ti en es or le qué ch ung lich ción ado eau ment ge ver sch ö ü é ra".split()
    return "".join(rng.choices(parts, k=rng.randint(1, 5)))


def labelled_rows(copies: int = 14, seed: int = 5) -> list[tuple[list[str], list[int]]]:
    """The table with its placeholders drawn ``copies`` times: words and label numbers."""
    rng = random.Random(seed)
    draw = {
        "FIRST": lambda: rng.choice(_FIRST), "LAST": lambda: rng.choice(_LAST), "STREET": lambda: rng.choice(_STREET), "WAY": lambda: rng.choice(_WAY), "TOWN": lambda: rng.choice(_TOWN),
        "GERMAN": lambda: rng.choice(_GERMAN), "FRENCH": lambda: rng.choice(_FRENCH), "SPANISH": lambda: rng.choice(_SPANISH), "ZIP": lambda: f"{rng.randint(10000, 99999)}",
        "NUM": lambda: str(rng.choice([rng.randint(1, 99), rng.randint(100, 399), rng.randint(1000, 2030)])), "USER": lambda: rng.choice([rng.choice(_FIRST).lower(), f"{rng.choice(_FIRST)[0].lower()}.{rng.choice(_LAST).lower()}"]) + rng.choice(["", "", str(rng.randint(1, 99))]), "HOST": lambda: rng.choice(["mail", "example", "post", "inbox", _made_up(rng)]),
        "LOCAL": lambda: f"{rng.randint(200, 999)}{rng.choice('--.')}{rng.randint(0, 9999):04d}", "LONG": lambda: str(rng.randint(100_000, 99_999_999)), "PAIR": lambda: f"{rng.randint(1, 99):02d}", "AREA": lambda: str(rng.randint(200, 999)), "word": lambda: _made_up(rng), "Word": lambda: _made_up(rng).capitalize(), "Cap": lambda: _made_up(rng).capitalize(), "cap": lambda: _made_up(rng).capitalize(),
        "CAP": lambda: _made_up(rng).upper(), "IP": lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)), "MAIL": lambda: f"{_made_up(rng)}.{rng.randint(10, 99)}@mail{rng.randint(0, 9)}.example.com",
        "CODE": lambda: "".join(rng.choices("abcdefABCDEF0123456789_", k=24)), "CARD": lambda: str(rng.randint(10**15, 10**16 - 1)), "INTL": lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(0, 9999):04d}",
    }
    slot = re.compile(r"\b(" + "|".join(sorted(draw, key=len, reverse=True)) + r")(?![A-Za-z])|\bGERMAN|(?<=0)AREA")
    fill = lambda s: slot.sub(lambda m: draw[m[0]](), s)
    out = []
    for _ in range(copies):
        for row in TABLE:
            tokens, gold, at = [], [], 0
            for m in [*_ENDING.finditer(row), None]:
                plain = fill(row[at : m.start() if m else len(row)]).split()
                if tokens and at and not row[at : at + 1].isspace() and plain:
                    tokens[-1] += plain.pop(0)
                tokens += plain
                gold += [0] * (len(tokens) - len(gold))
                if m:
                    span = fill(m[2]).split()
                    b = LABELS.index(f"B-{m[1]}")
                    tokens += span
                    gold += [b, *[b + 1] * (len(span) - 1)]
                    at = m.end()
            out.append((tokens, gold))
    return out


def noise_rows(n: int = 2000, seed: int = 6) -> list[tuple[list[str], list[int]]]:
    """Sentences by rule that hold no personal data: made-up words in any case, numbers, codes, marks, and words of ``CUES`` out of place."""
    rng = random.Random(seed)
    small, marks = sorted(CUES - FAR), "*#%&$!?|~^=+_<>/@"
    kinds = [lambda: _made_up(rng), lambda: _made_up(rng).capitalize(), lambda: _made_up(rng).upper(), lambda: str(rng.randint(0, 10 ** rng.randint(1, 8))), lambda: rng.choice(small), lambda: rng.choice(small).capitalize(), lambda: "".join(rng.choices("abcdefABCDEF0123456789_", k=rng.randint(3, 30)))]
    out = []
    for _ in range(n):
        weights = [rng.random() ** 2 for _ in kinds]
        mark = rng.choice(marks) * rng.randint(1, 4) if rng.random() < 0.3 else ""
        comma = rng.choice([0.0, 0.1, 0.3])
        tokens = [rng.choices(kinds, weights)[0]() + (rng.choice(",.;:") if rng.random() < comma else "") + (mark if rng.random() < 0.8 else "") for _ in range(rng.randint(1, 16))]
        if rng.random() < 0.15:  # stutter
            tokens = [t for t in tokens[:4] for _ in range(rng.randint(3, 30))]
        tokens[-1] += rng.choice([".", "", "", "!"])
        out.append((tokens, [0] * len(tokens)))
    return out


# ---- features and model ------------------------------------------------------------------------

#: Words that announce personal data, in the four languages; known at a distance of two words as well.
FAR = frozenset("""name named called mr mrs ms dr prof regards sincerely signed contact patient customer dear address live lives deliver email mail phone tel call mobile write reach number
heiße herr frau grüßen ansprechpartner adresse wohne telefon handy nummer rufen schreiben hausarzt
m'appelle nom madame monsieur cordialement contacter habite j'habite téléphone appelez écrivez
llamo nombre señora señor sr sra atentamente vivo dirección teléfono llame correo estimada""".split())
#: Words whose identity is a feature of themselves and their neighbours; all others are known by their shape only.
CUES = FAR | frozenset("""am by at dot (at) (dot) com org net de fr es punkt point punto arobase arroba street road avenue lane drive boulevard st rd rue calle avenida is under to and the of from for ask with on in my i me
ist in der und an mein meine sie unter den die das est et le la au je mon à es y el en mi a por al""".split())
_SHORT = frozenset("mr mrs ms dr prof st rd sr sra".split())
_EDGE = "\"'.,;:!?()[]{}"
_RUNS = [(re.compile(r"x{2,}"), "xx"), (re.compile(r"X{2,}"), "XX"), (re.compile(r"d{5,}"), "ddddd"), (re.compile(r"([^xXd])\1{2,}"), r"\1\1")]
_PLACES = ("straße", "strasse", "weg", "platz", "allee")


class _Classes(dict):
    """Code point -> its character class."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = "X" if c.isupper() else "x" if c.isalpha() else "d" if c.isdigit() else c
        return out


_CLASSES, _SHAPES = _Classes(), {}


def shape(word: str) -> str:
    """Character classes of the whole word, runs shortened."""
    classes = word.translate(_CLASSES)
    out = _SHAPES.get(classes)
    if out is None:
        out = classes
        for run, short in _RUNS:
            out = run.sub(short, out)
        if len(classes) <= LONG:
            if len(_SHAPES) > 100_000:
                _SHAPES.clear()
            _SHAPES[classes] = out
    return out


def word_key(word: str) -> tuple:
    """All that the features see of a word, and whether it ends a sentence."""
    bare = word.strip(_EDGE)
    low = bare.lower()
    whole = low if len(bare) == len(word) else word.lower()
    cue = whole if whole in CUES else low if low in CUES else ""
    last = word[-1]
    return shape(word), shape(bare), cue, "" if last.isalnum() else last, low.endswith(_PLACES), min(len(low), 8), word[0].isupper(), last in ".!?" and low not in _SHORT


def features(key: tuple) -> tuple[str, ...]:
    whole, bare, cue, tail, place, size, upper, _ = key
    return (f"s={whole}", f"b={bare}", f"c={cue}", f"t={tail}{'straße' if place else ''}", f"ct={cue}{tail}", f"n={size}{upper}", f"f={cue if cue in FAR else ''}")


def word_features(word: str) -> tuple[str, ...]:
    return features(word_key(word))


def ends_sentence(word: str) -> bool:
    return word[-1] in ".!?" and word.strip(_EDGE).lower() not in _SHORT


_SPELLED = re.compile(r"\b(?:at|dot|arroba|arobase|punkt|punto|point)\b", re.IGNORECASE)


def plausible(kind: str, span: str) -> bool:
    """What every span of a kind has: names only words that begin with a capital, addresses a number, contacts a number or a spelled-out sign."""
    if kind == "name":
        return all(w[0].isupper() for w in span.split())
    return any(c.isdigit() for c in span) or kind == "contact" and bool(_SPELLED.search(span))


class PiiModel:
    """CRF weights, with words interned to classes of equal features."""

    def __init__(self, memo: int = 300_000) -> None:
        rows = labelled_rows() + noise_rows()
        self.names: dict[str, int] = {"": 0}
        feats, gold, lengths = [], [], []
        for tokens, labels in rows:
            begin = 0
            ends = [i + 1 for i, w in enumerate(tokens) if ends_sentence(w) or i + 1 == len(tokens)]
            for end in ends:  # a chain is a sentence, as in decoding
                own = [word_features(w) for w in tokens[begin:end]]
                for i in range(len(own)):
                    around = [("p", own[i - 1][:-1] if i else ("edge",)), ("o", own[i][:-1]), ("n", own[i + 1][:-1] if i + 1 < len(own) else ("edge",))]
                    around += [(slot, own[j][-1:]) for slot, j in (("pp", i - 2), ("nn", i + 2)) if 0 <= j < len(own) and own[j][-1] != "f="]
                    got = [self.names.setdefault(s + f, len(self.names)) for s, fs in around for f in fs]
                    feats.append(got + [0] * (20 - len(got)))
                gold += labels[begin:end]
                lengths.append(end - begin)
                begin = end
        table = np.array(feats, np.int64)
        self.w, self.trans = crf.fit(table, np.array(gold), np.array(lengths), len(self.names), len(LABELS), rounds=80, penalty=0.5)
        self.limit = memo
        self.prepare()

    def prepare(self) -> None:
        self.w[0] = 0.0
        for b in range(1, len(LABELS), 2):  # an inside label follows its own kind only
            for before in range(len(LABELS)):
                if before not in (b, b + 1):
                    self.trans[before, b + 1] = -1e4
        self.first = np.array([-1e4 if i and i % 2 == 0 else 0.0 for i in range(len(LABELS))])
        gain = np.delete(self.trans - self.trans[0, 0], 0, 1).max()
        self.slack = max(0.0, gain) + max(0.0, (self.trans[1:, 0] - self.trans[0, 0]).max())
        self.clear()

    def clear(self) -> None:
        self.classes: dict[tuple, int] = {}
        self.index: dict[str, int] = {}
        self.by_key: dict[tuple, int] = {}
        self.ends: list[bool] = []
        self.far: list[bool] = []
        self.rows: list[np.ndarray] = []
        self.of_class(("edge", ""), False)
        self.table = np.zeros((0, 5, len(LABELS)), np.float32)

    def of_class(self, feats: tuple, end: bool) -> int:
        """The class of words that the weights can't tell apart: unknown features count for nothing."""
        slots = [[self.names[s + f] for f in fs if s + f in self.names] for s, fs in (("p", feats[:-1]), ("o", feats[:-1]), ("n", feats[:-1]), ("pp", feats[-1:]), ("nn", feats[-1:]))]
        key = (*map(tuple, slots), end)
        if key not in self.classes:
            self.classes[key] = len(self.rows)
            self.rows.append(np.stack([self.w[x].sum(0) for x in slots]).astype(np.float32))
            self.ends.append(end)
            self.far.append(bool(slots[3] or slots[4]))
        return self.classes[key]

    def intern(self, texts: list[list[str]]) -> list[np.ndarray]:
        if max(len(self.index), len(self.by_key), len(self.rows)) > self.limit:
            self.clear()
        index, by_key = self.index, self.by_key
        long = []
        for w in set().union(*texts).difference(index):
            key = word_key(w)
            code = by_key.get(key)
            if code is None:
                code = self.of_class(features(key), key[-1])
                if len(w) <= LONG:
                    by_key[key] = code
            index[w] = code
            if len(w) > LONG:
                long.append(w)
        if len(self.table) < len(self.rows):
            self.table = np.stack(self.rows)
        codes = [np.fromiter(map(index.__getitem__, t), np.int64, len(t)) for t in texts]
        for w in long:  # the memos are bounded in bytes too
            del index[w]
        return codes

    def scores(self, flat: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Label scores of words by class, of their neighbours, and of announcing words two places away, within sentences."""
        before, after = np.where(first, 0, np.roll(flat, 1)), np.where(last, 0, np.roll(flat, -1))
        scores = self.table[flat, 1] + self.table[before, 0] + self.table[after, 2]
        far = np.flatnonzero(np.array(self.far)[flat])
        chain = np.cumsum(first)
        for slot, step in ((3, 2), (4, -2)):
            to = far + step
            ok = (to >= 0) & (to < len(flat))
            ok[ok] = chain[to[ok]] == chain[far[ok]]
            scores[to[ok]] += self.table[flat[far[ok]], slot]
        return scores

    def tag(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Label numbers of every word of every text."""
        codes = self.intern(texts)
        size = np.array([len(c) for c in codes], np.int64)
        flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        out = np.zeros(len(flat), np.int8)
        if len(flat):
            last = np.array(self.ends)[flat]
            last[(np.cumsum(size) - 1)[size > 0]] = True
            first = np.concatenate([[True], last[:-1]])
            scores = self.scores(flat, first, last)
            chain = np.cumsum(first) - 1
            open_ = (scores[:, 1:].max(1) - scores[:, 0] + self.slack) > -1e-3
            wanted = np.zeros(chain[-1] + 1, bool)
            wanted[chain[open_]] = True
            rows = np.flatnonzero(wanted[chain])
            if len(rows):
                lengths = np.bincount(chain[rows], minlength=len(wanted))[wanted]
                part = scores[rows].astype(np.float64)
                part[first[rows]] += self.first
                out[rows] = crf.viterbi(part, self.trans, crf.Layout(lengths))
        return np.split(out, np.cumsum(size)[:-1])

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """All spans of each text: the base ones, and those of the CRF that touch none of them."""
        words = [t.split() for t in texts]
        out = []
        for text, labels in zip(texts, self.tag(words)):
            found = base_spans(text)
            if labels.any():
                taken = sorted((a, b) for _, a, b in found)
                more = []
                places = [m.span() for m in re.finditer(r"\S+", text)] if len(labels) else []
                if len(places) != len(labels):  # blanks that only str.split knows
                    places, at = [], 0
                    for w in text.split():
                        at = text.index(w, at)
                        places.append((at, at + len(w)))
                        at += len(w)
                i = 0
                while i < len(labels):
                    if labels[i]:
                        j = i + 1
                        while j < len(labels) and labels[j] and labels[j] % 2 == 0:
                            j += 1
                        a, b = places[i][0], places[j - 1][1]
                        while b > a and text[b - 1] in ".,;:!?)":
                            b -= 1
                        kind = ADDED[(labels[i] - 1) // 2]
                        if b > a and plausible(kind, text[a:b]) and not any(x < b and a < y for x, y in taken):
                            more.append((kind, a, b))
                        i = j
                    else:
                        i += 1
                found += sorted(more, key=lambda s: (ADDED.index(s[0]), s[1]))
            out.append(found)
        return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span, overlapping ones as one, replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


_MODEL: list[PiiModel] = []


def model() -> PiiModel:
    """Trained once a process from the labelled table; the same everywhere."""
    if not _MODEL:
        _MODEL.append(PiiModel())
    return _MODEL[0]


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row; counts are of the four listed kinds.

    A null text counts as empty: no spans, the digest of the empty string. Null ids and repeated rows
    each give a row; other columns are not read; an empty table gives no rows; very long texts are searched whole, a
    slice of a batch at a time. One pass without a shuffle.
    """
    trained = model()
    shared = df.sparkSession.sparkContext.broadcast((trained.names, trained.w, trained.trans))

    def run(batches):
        m = restored(*shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices([], map(len, texts), 1_000_000):
                found = m.spans(texts[a:b])
                base = [[s for s in f if s[0] in KINDS] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        *(pa.array([sum(s[0] == k for s in f) for f in base], pa.int64()) for k in KINDS),
                        pa.array([hashlib.sha256(joined(f).encode()).hexdigest() for f in base], pa.string()),
                        pa.array([joined(f) for f in found], pa.string()),
                    ],
                    names=[id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(thrifty(run, "pii"), f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def restored(names: dict[str, int], w: np.ndarray, trans: np.ndarray) -> PiiModel:
    """A model with given weights; the worker doesn't train."""
    if not _MODEL:
        m = PiiModel.__new__(PiiModel)
        m.names, m.w, m.trans, m.limit = names, w, trans, 300_000
        m.prepare()
        _MODEL.append(m)
    keeps("pii", _MODEL.clear)
    return _MODEL[0]


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` and ``n_chars`` kept true; null texts stay null.

    Every row stays: repeated ones are redacted alike, null ids pass through, an empty table gives no rows,
    extra columns of whatever name are copied. Very long texts are worked whole, in bounded slices of a batch.
    """
    trained = model()
    shared = docs.sparkSession.sparkContext.broadcast((trained.names, trained.w, trained.trans))
    columns = docs.columns

    def run(batches):
        m = restored(*shared.value)
        for batch in batches:
            raw = batch.column("text").to_pylist()
            for a, b in slices([], (len(t or "") for t in raw), 1_000_000):
                part = [t or "" for t in raw[a:b]]
                new = [None if r is None else redact(t, s) for r, t, s in zip(raw[a:b], part, m.spans(part))]
                cols = []
                for c in columns:
                    old = batch.column(c).slice(a, b - a)
                    if c == "text":
                        old = pa.array(new, pa.string())
                    elif c == "n_chars":
                        old = pa.array([n if t is None else len(t) for n, t in zip(old.to_pylist(), new)], old.type)
                    cols.append(old)
                yield pa.RecordBatch.from_arrays(cols, names=columns)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(thrifty(run, "pii"), schema)
