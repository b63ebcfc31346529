"""PII surrogates: keyed, type-consistent replacements that keep format, script and gender.

An entity's variable characters are read as a number in the mixed radix of their
classes (vowels, consonants, digits, hexadecimal digits, ...), and a keyed permutation of that range without
fixed points gives the surrogate's.  So one entity has one surrogate everywhere
(coreference), two entities of a form never share one (distinctness), no entity
keeps its value, and no table of entities is needed.  Names permute within lists of one gender and
script.  Luhn numbers stay valid.  collisions() checks distinctness over a corpus.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .components import Scratch

# Given names by gender and script, titles that tell a name follows, phrases that do, and family names of one character.
GIVEN = {
    ("f", "latin"): "Aisha Alice Amina Ana Anna Beatriz Camille Carmen Chiara Clara Claire Elena Elif Emma Eva Fatima Giulia Hanna Helen Ines Ingrid Isabel Ivana Jana Julia Katarzyna Laura Leila Lucia Maja Manon Maria Marie Martha Mei Nina Olivia Paula Priya Rosa Sara Sarah Sofia Teresa Yuki Zoë Zoe Zuzana".split(),
    ("m", "latin"): "Adam Ahmed Albert Ali Andrzej Antonio Arjun Carlos Daniel David Diego Emre Felix Giovanni Henry Hiroshi Hugo Ibrahim Ivan Jakob James Jan João John José Juan Karl Lars Louis Lucas Luca Marco Martin Matteo Mehmet Miguel Mohammed Omar Oscar Pablo Pedro Peter Pierre Rajesh Sergio Stefan Thomas Tomasz".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Екатерина Елена Ирина Мария Наталья Нина Ольга Светлана Татьяна".split(),
    ("m", "cyrillic"): "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Олег Пётр Сергей Юрий".split(),
}
TITLES_F = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа")
TITLES_M = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин")
TITLES_ANY = ("Dr", "Prof")
CUES = ("my name is", "name:", "full name:", "contact:", "attn:", "regards,", "sincerely,", "signed,", "mein name ist", "ich heiße", "je m'appelle", "nom:", "me llamo", "mi nombre es", "nombre:", "меня зовут", "имя:")
HAN_FAMILY = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金"
HAN_TITLES, HAN_CUES = "先生|女士|小姐|老师|教授|博士|医生", "我叫|我是|名叫|姓名[:：]"

#: Letters and digits of one class stand for one another; a class keeps script, accents and the look of a word.
_GROUPS = ("aeiouy", "bcdfghjklmnpqrstvwxz", "0123456789", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщьъ", "éèêëáàâäãåāăąíìîïīóòôöõøőúùûüūůűæœěęėý", "ñçćčďđğłńňřśšşťţźžż")
_CLASS = {c: g for g in _GROUPS for c in g}
_HEX = dict.fromkeys("0123456789abcdef", "0123456789abcdef")
_DIGIT = {c: "0123456789" for c in "0123456789"}
_ALNUM = {c: "abcdefghijklmnopqrstuvwxyz" for c in "abcdefghijklmnopqrstuvwxyz"} | _DIGIT
#: Endings that tell gender or a kind of family name; they stay.
_SUFFIX = re.compile("(?:ова|ева|ёва|ина|ская|ов|ев|ёв|ин|ский|ina|ella|ette|elle|ine|ia|ka|a|o|us)$", re.I)
_HAN_FIRST, _HAN_COUNT = 0x4E00, 0x9FA6 - 0x4E00


class Permutation:
    """Keyed permutations of ranges, by a Feistel network with cycle walking."""

    ROUNDS = 6

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _f(self, tweak: bytes, r: int, half: int, x: int) -> int:
        size = (half + 7) // 8
        raw = hashlib.blake2b(tweak + bytes([r]) + x.to_bytes(size + 1, "big"), key=self.key, digest_size=min(64, max(8, size))).digest()
        while len(raw) < size:
            raw += hashlib.blake2b(raw, key=self.key).digest()
        return int.from_bytes(raw, "big") & ((1 << half) - 1)

    def _walk(self, x: int, n: int, tweak: bytes, rounds: range, back: bool) -> int:
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            a, b = x >> half, x & mask
            for r in rounds:
                a, b = (b ^ self._f(tweak, r, half, a), a) if back else (b, a ^ self._f(tweak, r, half, b))
            x = a << half | b
            if x < n:
                return x

    def moved(self, x: int, n: int, tweak: bytes) -> int:
        """Image of x under a permutation of range(n) that moves every element; x itself if n is 1."""
        if n < 2:
            return x
        down = self._walk(x, n, tweak, range(self.ROUNDS - 1, -1, -1), True)
        return self._walk((down + 1) % n, n, tweak, range(self.ROUNDS), False)


class Surrogates:
    """Surrogates of entities under one secret key, with a bounded memo."""

    def __init__(self, key: str, memo: int = 200_000) -> None:
        self.perm, self.memo, self.most = Permutation(key.encode()), {}, memo
        self.lists = {name: (kind, names, i) for kind, names in GIVEN.items() for i, name in enumerate(names)}

    def of(self, kind: str, value: str) -> str:
        got = self.memo.get((kind, value))
        if got is None:
            if len(self.memo) >= self.most:
                self.memo.clear()
            got = self.memo[kind, value] = getattr(self, kind)(value)
        return got

    def shaped(self, kind: str, text: str, classes: dict[str, str], fixed: Callable[[int], bool] = lambda i: False) -> str:
        """Permutes the characters that have a class, but for fixed places; case and the rest stay."""
        n, x, at = 1, 0, []
        form = []
        for i, c in enumerate(text):
            own = classes.get(c.lower())
            if own is None or fixed(i) or len(own) < 2:
                form.append(c)
                continue
            form.append(own[0])
            at.append((i, own))
            x = x * len(own) + own.index(c.lower())
            n *= len(own)
        y = self.perm.moved(x, n, f"{kind}|{''.join(form)}|{len(text)}".encode())
        out = list(text)
        for i, own in reversed(at):
            y, d = divmod(y, len(own))
            out[i] = own[d].upper() if text[i].isupper() else own[d]
        return "".join(out)

    def email(self, value: str) -> str:
        local, _, domain = value.rpartition("@")
        host, dot, top = domain.rpartition(".")
        if not re.search(r"(?:^|\.)example$", host, re.I):
            host = self.shaped("host", host.lower(), _CLASS)
        # The domain is part of the tweak, so mailboxes stay distinct within and across domains.
        return self.shaped("mail@" + domain.lower(), local.lower(), _CLASS) + "@" + host + dot + top

    def phone(self, value: str) -> str:
        country = len(m[0]) if (m := re.match(r"\+\d{1,3}(?=[ (-])", value)) else 0
        first = {i for i in range(country, len(value)) if value[i] not in "01" and value[i - 1 : i] in ("", " ", "(", "-", ".")}
        low = {c: "23456789" for c in "23456789"}
        digits = [low if i in first else _DIGIT for i in range(len(value))]
        n, x, at = 1, 0, []
        for i in range(country, len(value)):
            own = digits[i].get(value[i])
            if own and not (value[i] in "01" and value[i - 1 : i] in ("", " ", "(", "-", ".")):
                at.append((i, own))
                x, n = x * len(own) + own.index(value[i]), n * len(own)
        y, out = self.perm.moved(x, n, f"phone|{''.join(c if i not in dict(at) else 'dD'[i in first] for i, c in enumerate(value))}".encode()), list(value)
        for i, own in reversed(at):
            y, d = divmod(y, len(own))
            out[i] = own[d]
        return "".join(out)

    def ip(self, value: str) -> str:
        parts = [int(p) for p in value.split(".")]
        free = [i for i, p in enumerate(parts) if 0 < p < 255]
        x = 0
        for i in free:
            x = x * 254 + parts[i] - 1
        y = self.perm.moved(x, 254 ** len(free), ("ip|" + ".".join("x" if i in free else str(p) for i, p in enumerate(parts))).encode())
        for i in reversed(free):
            y, d = divmod(y, 254)
            parts[i] = d + 1
        return ".".join(map(str, parts))

    def number(self, value: str) -> str:
        """Account and card numbers: first digit, separators and distance from the Luhn digit stay."""
        at = [i for i, c in enumerate(value) if c.isdigit()]
        luhn = lambda s: -sum(d if k % 2 else (2 * d - 9 * (d > 4)) for k, d in enumerate(int(s[i]) for i in reversed(at[:-1]))) % 10
        gap = (int(value[at[-1]]) - luhn(value)) % 10
        # The last digit follows from the others, so it has no part in the permutation or its tweak.
        rest = value[: at[-1]] + "0" + value[at[-1] + 1 :]
        out = self.shaped(f"number{gap}", rest, _DIGIT, lambda i: i in (at[0], at[-1]))
        return out[: at[-1]] + str((luhn(out) + gap) % 10) + out[at[-1] + 1 :]

    def ssn(self, value: str) -> str:
        return self.shaped("ssn", value, _DIGIT)

    def secret(self, value: str) -> str:
        low = value.lower()
        if value in (low, value.upper()) and all(c in _HEX for c in low):
            return self.shaped("hex", value, _HEX)
        return self.shaped("secret" + "".join("u" if c.isupper() else "-" for c in value), value, _ALNUM)

    def ip6(self, value: str) -> str:
        return self.shaped("ip6", value.lower(), _HEX)

    def iban(self, value: str) -> str:
        """Account numbers with check digits of remainder 97: country and format stay, the check digits are made anew."""
        body = self.shaped("iban" + value[:2], value[4:], _ALNUM)
        as_number = "".join(str(int(c, 36)) for c in (body.replace(" ", "") + value[:2]).upper()) + "00"
        return value[:2] + f"{98 - int(as_number) % 97:02d}" + body

    def word(self, word: str) -> str:
        """One word of a name.

        Listed given names move within their list.  Any other word moves among the words of its shape and ending that are
        not listed: the permutation of the shape is taken again until such a word comes.  So the images of two words differ.
        """
        shown = word[:1].upper() + word[1:].lower()
        if shown in self.lists:
            kind, names, i = self.lists[shown]
            new = names[self.perm.moved(i, len(names), f"given|{kind}".encode())]
            return new.upper() if word.isupper() and len(word) > 1 else new
        end = lambda w: m.start() if (m := _SUFFIX.search(w)) and m.start() > 1 else len(w)
        stem, new = end(word), word
        for _ in range(10_000):
            new = self.shaped(f"name{stem}", new, _CLASS, lambda i: i >= stem)
            if end(new) == stem and new[:1].upper() + new[1:].lower() not in self.lists:
                return new
        return new

    def han(self, value: str) -> str:
        """A Chinese name: the family name moves in its list, the rest among Han characters."""
        family, rest = value[0], value[1:]
        x = 0
        for c in rest:
            x = x * _HAN_COUNT + ord(c) - _HAN_FIRST
        y, out = self.perm.moved(x, _HAN_COUNT ** len(rest), f"han|{len(rest)}".encode()), ""
        for _ in rest:
            y, d = divmod(y, _HAN_COUNT)
            out = chr(_HAN_FIRST + d) + out
        return HAN_FAMILY[self.perm.moved(HAN_FAMILY.index(family), len(HAN_FAMILY), b"han")] + out

    def name(self, value: str) -> str:
        """A person's name, word by word; marks between words stay."""
        if value[:1] in HAN_FAMILY:
            return self.han(value)
        return "".join(self.word(w) if w[:1].isalpha() else w for w in re.split(r"([ '’-])", value) if w)


_LETTERS = "A-ZÀ-ÖØ-ÞĀ-ſА-ЯЁ"
_lower = "a-zß-öø-ÿĀ-ſа-яё"
_NUMERIC = re.compile(
    r"(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d))"
    r"|(?P<number>(?<![\dA-Za-z])(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\dA-Za-z]))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ -]?)?(?:\(\d{2,4}\)[ -]?|\d{2,4}[ -])\d{3,4}[ -]\d{3,4}(?!\w)|(?<![\w+])\+\d{7,15}(?!\w)"
    r"|(?<![\w+.-])0\d(?:[ .-]\d{2}){4}(?![\w-])|(?<![\w+.-])[2-9]\d{2}-\d{4}(?![\w-]))"
)
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_IP6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*[0-9A-Fa-f])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_SECRET = re.compile(r"(?i:token|api[_-]?key|secret|passw(?:or)?d|access[_-]?key)[\"']?\s*[=:]\s*[\"']?(?P<secret>[A-Za-z0-9_+/-]{8,})")
_HEXRUN = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16})(?![0-9A-Za-z])")
_TITLE = "|".join(re.escape(t) for t in TITLES_F + TITLES_M + TITLES_ANY)
_GIVEN = "|".join(n for names in GIVEN.values() for n in names)
_DIGITS = re.compile(r"\d")
_CUE = "|".join(re.escape(c).replace("\\ ", " +") for c in CUES)
_WORD = rf"(?:[{_LETTERS}]['’])?[{_LETTERS}][{_lower}]+(?:['’-][{_LETTERS}][{_lower}]+)*"
_NAME = re.compile(rf"\b(?:(?:{_TITLE})\.? (?P<a>{_WORD}(?: {_WORD})?)|(?P<b>(?:{_GIVEN}) {_WORD})|(?i:{_CUE})\s+(?P<c>{_WORD} {_WORD}))(?!\w)")
_BEFORE_MAIL = re.compile(rf"\b(?P<d>{_WORD} {_WORD}) <(?=[^<>\s]+@)")
_HAN = re.compile(rf"(?:{HAN_CUES})(?P<a>[{HAN_FAMILY}][一-龥]{{1,2}})(?![一-龥])|(?P<b>[{HAN_FAMILY}][一-龥]{{1,2}})(?={HAN_TITLES})")
_HAN_MARKS = (*(c.removesuffix("[:：]") for c in HAN_CUES.split("|")), *HAN_TITLES.split("|"))
_RUNS = re.compile(r"[^\W\d_]+")
_NAME_WORDS = frozenset((*TITLES_F, *TITLES_M, *TITLES_ANY, *(n for names in GIVEN.values() for n in names)))


def _may_name(text: str) -> bool:
    """Whether a title, a listed name or a cue is in the text at all: cheap, for most texts have none."""
    if not _NAME_WORDS.isdisjoint(_RUNS.findall(text)):
        return True
    low = text.lower()
    return any(c in low for c in CUES)


def _valid_iban(text: str) -> bool:
    own = text.replace(" ", "")
    return 15 <= len(own) <= 34 and int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1


def _valid_ip6(text: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(text)) and sum(bool(g) for g in text.split(":")) > 2
    except ValueError:
        return False


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of entities, in order, without overlaps; the earlier kind in the code wins a place."""
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        at = text.find("@")
        while at >= 0:
            # The pattern is tried near the sign only.
            start = at
            while start and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
                start -= 1
            if m := _EMAIL.match(text, start):
                found.append((m.start(), m.end(), "email"))
            at = text.find("@", max(at + 1, m.end() if m else 0))
    if any(x in text for x in ("=", ":")):
        found += [(*m.span("secret"), "secret") for m in _SECRET.finditer(text)]
    if "::" in text or text.count(":") > 6:
        found += [(*m.span(), "ip6") for m in _IP6.finditer(text) if _valid_ip6(m[0])]
    if _DIGITS.search(text):
        found += [(*m.span(), "secret") for m in _HEXRUN.finditer(text)]
        found += [(*m.span(), "iban") for m in _IBAN.finditer(text) if _valid_iban(m[0])]
        found += [(*m.span(), "number" if m.lastgroup == "gap" else m.lastgroup) for m in _NUMERIC.finditer(text)]
    if _may_name(text):
        found += [(*m.span(next(g for g in "abc" if m[g])), "name") for m in _NAME.finditer(text)]
    if " <" in text and "@" in text:
        found += [(*m.span("d"), "name") for m in _BEFORE_MAIL.finditer(text)]
    if not text.isascii() and any(c in text for c in _HAN_MARKS):
        found += [(*m.span("a" if m["a"] else "b"), "name") for m in _HAN.finditer(text)]
    if len(found) < 2:
        return found
    rank = {"email": 0, "secret": 1, "iban": 2, "ip": 3, "ip6": 4, "number": 5, "ssn": 6, "phone": 7, "name": 8}
    taken: list[tuple[int, int, str]] = []
    for s in sorted(found, key=lambda s: (s[0], rank[s[2]], -s[1])):
        if taken and s[0] < taken[-1][1]:
            if rank[s[2]] < rank[taken[-1][2]]:
                taken[-1] = s
            continue
        taken.append(s)
    return taken


_made: dict[str, Surrogates] = {}


def _surrogates(key: str) -> Surrogates:
    if key not in _made:
        _made[key] = Surrogates(key)
    return _made[key]


def _token(own: Surrogates, kind: str, value: str) -> int:
    """A keyed hash of an entity's value; but for secrets, case doesn't count."""
    raw = (value if kind == "secret" else value.lower()).encode()
    return int.from_bytes(hashlib.blake2b(raw, key=own.perm.key, digest_size=8).digest(), "big", signed=True)


def replace_text(text: str, own: Surrogates) -> tuple[str, list[tuple[str, int, int, str]]]:
    """The text with surrogates, and (kind, start, end, surrogate) by place in the original."""
    spans = [(kind, a, b, own.of(kind, text[a:b])) for a, b, kind in find(text)]
    if not spans:
        return text, []
    out, last = [], 0
    for _, a, b, new in spans:
        out += [text[last:a], new]
        last = b
    return "".join([*out, text[last:]]), spans


def replace(docs: DataFrame, key: str, *, text_col: str = "text", with_spans: bool = True) -> DataFrame:
    """Replaces entities in every whole text.

    Returns all columns of ``docs`` with ``text_col`` rewritten, n_entities long, and if asked for
    ``entities`` array of (kind, start, end, surrogate, token), replacing columns of those names; token is a keyed hash of
    the entity, the same wherever it occurs.
    Null texts stay null with 0 entities; repeated rows come out alike.
    """
    names = [c for c in docs.columns if c not in ("n_entities", "entities")]
    own = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema) + ", n_entities long" + ", entities array<struct<kind:string,start:int,end:int,surrogate:string,token:bigint>>" * with_spans
    where = names.index(text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string()), ("token", pa.int64())]))

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _surrogates(key)
        for batch in batches:
            texts, counts, spans = [], [], []
            for t in batch.column(where).to_pylist():
                new, found = replace_text(t, made) if t else (t, [])
                texts.append(new)
                counts.append(len(found))
                if with_spans:
                    spans.append([dict(zip(("kind", "start", "end", "surrogate", "token"), (*s, _token(made, s[0], t[s[1] : s[2]])))) for s in found])
            columns = [pa.array(texts, batch.column(i).type) if i == where else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), *[pa.array(spans, kind)] * with_spans], [*names, "n_entities", *["entities"] * with_spans])

    return own.mapInArrow(run, schema)


def _shared(replaced: DataFrame) -> DataFrame:
    """(kind, surrogate) that stand for more than one entity, of a result with entities; two numbers a surrogate are aggregated."""
    e = replaced.select(F.explode("entities").alias("e"))
    shown = F.when(F.col("e.kind") == "secret", F.col("e.surrogate")).otherwise(F.lower("e.surrogate"))
    return e.groupBy(F.col("e.kind").alias("kind"), shown.alias("surrogate")).agg(F.min("e.token").alias("lo"), F.max("e.token").alias("hi")).where("lo != hi").select("kind", "surrogate")


def _split(replaced: DataFrame) -> DataFrame:
    """(kind, token) of entities that have more than one surrogate."""
    e = replaced.select(F.explode("entities").alias("e"))
    shown = F.when(F.col("e.kind") == "secret", F.col("e.surrogate")).otherwise(F.lower("e.surrogate"))
    return e.groupBy(F.col("e.kind").alias("kind"), F.col("e.token").alias("token")).agg(F.min(shown).alias("lo"), F.max(shown).alias("hi")).where("lo != hi").select("kind", "token")


def replace_checked(docs: DataFrame, key: str, *, text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """replace(), written to the shared folder and checked over the whole corpus before it is returned.

    Raises if a surrogate stands for two entities, or an entity has two surrogates.  The permutations are one-to-one, so neither can
    come about but by a fault; the check says so rather than trusting it.
    """
    scratch = Scratch(docs.sparkSession)
    out = scratch.keep(replace(docs, key, text_col=text_col, with_spans=True))
    for what, found in (("a surrogate for two entities", _shared(out)), ("an entity with two surrogates", _split(out))):
        if bad := found.limit(1).collect():
            scratch.drop(out)
            raise ValueError(f"{what}, of kind {bad[0].kind}")
    return out if with_spans else out.drop("entities")


def collisions(docs: DataFrame, key: str, *, text_col: str = "text") -> DataFrame:
    """Surrogates that stand for more than one entity of the corpus: (kind, surrogate). None should."""
    return _shared(replace(docs.select(F.col(text_col).alias("text")), key))
