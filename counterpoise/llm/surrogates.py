"""Personal data: keyed surrogates of the same type, gender, script and format.

1. Entities (mail addresses, phone, card and bank numbers, IP addresses, secrets, titled names) are
   found in whole texts, with every other capitalised mention of a titled name's words and every
   bare mention of a secret in the same text, and reduced to a normal form, so that spellings of
   one entity agree.  Assigned secrets, long hexadecimal strings and tokens of well-known formats
   are one type.  Titles count in any case, names with a capital.  A word of AMBIGUOUS without a
   title is left alone where it opens a sentence.
2. Every distinct entity gets a surrogate from an HMAC of type, normal form and attempt number:
   digits become digits, letters become letters of the same script and case, card numbers keep
   their check digit valid, addresses stay addresses.  Names are replaced word by word, whatever
   their title: 'Dr Berg', 'Frau Berg' and 'Anna Berg' share a word, and its surrogate.  A word
   seen as a given name gets one of its script and of the gender of its titles, if they agree.
   Initials are replaced by a keyed permutation of the alphabet; particles stay.
3. Surrogates are checked over all entities: one that equals another surrogate or a real entity of
   its type is drawn again with the next attempt, until all are distinct.  The same entity has the
   same surrogate everywhere, different entities never share one.
   Words of names are one type.  Bank numbers keep country and valid check digits, phone numbers
   their country code.
4. Texts are rewritten with the entities they hold; the format of each spelling is kept.

Texts are searched once: rows and what was found in them are written to the shared folder and
read again.  Texts without entities are passed on as they are and not shuffled.  Entities are made
distinct before anything is joined, and a text is joined by its hash, so copies share one entry.

Defined results: a NULL text stays NULL, with 0 entities; rows are kept one by one, whatever their
id; overlapping finds go to the type named first in KINDS; an empty table gives no rows.  Input
columns named like an added column are replaced.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterpoise.llm.common import small_batches
from counterpoise.session import spool

MAX_ROUNDS = 64

# Titles by gender, and given names and surname parts by script and gender.
TITLES = {
    "m": "Mr Herr Monsieur Señor Sr Don Г-н Господин Κύριος",
    "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra Doña Г-жа Госпожа Κυρία",
    "n": "Dr Prof Mx",
}
GIVEN = {
    ("latin", "m"): "Adam Boris Carl David Emil Felix Georg Hugo Ivan Jonas Karim Leon Milan Nils",
    ("latin", "f"): "Alma Berta Clara Dora Elena Frida Greta Hanna Irma Julia Kira Lena Mona Nora",
    ("latin", "n"): "Alex Chris Dana Eli Jamie Kim Luca Mika Noa Robin Sam Sasha Toni Yuri",
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Марк Олег Павел Роман",
    ("cyrillic", "f"): "Анна Вера Галина Дарья Ева Зоя Ирина Кира Лидия Мария Нина Ольга",
    ("cyrillic", "n"): "Саша Женя Валя Слава Никита Шура",
    ("greek", "m"): "Αλέξης Γιώργος Δημήτρης Κώστας Μάνος Νίκος Πέτρος Στέλιος",
    ("greek", "f"): "Άννα Δάφνη Ελένη Ιωάννα Κατερίνα Μαρία Σοφία Χριστίνα",
    ("greek", "n"): "Αλέξης Χάρις",
}
SYLLABLES = {
    "latin": "ba be da del fa gor ha jen ka lan len mar mi nor pel ra ros sa sen tam tor va wel zan",
    "cyrillic": "ба бе ва гор да ен жа за ка лан лен мар ми нор пел ра рос са тор ха",
    "greek": "βα γε δα θε κα λα μα νε πα ρο σα τε φα χα",
}
# Names that are also words which often open a sentence.
AMBIGUOUS = set(
    "will may mark bill grace hope joy faith rose dawn art frank grant chase pat rich young long "
    "short brown black white green king price case wood stone hill june april august".split()
)
# Calling codes of one and of two digits; the others have three.
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
_TITLES = "|".join(sorted((re.escape(t) for s in TITLES.values() for t in s.split()), key=len)[::-1])
_TITLE = f"(?i:{_TITLES})"
_GENDER = {t.lower(): g for g, s in TITLES.items() for t in s.split()}
_UPPER = r"[^\W\d_a-zà-öø-ÿа-яά-ώ]"
_WORD = rf"(?:(?:{_UPPER}|[dl])['’])?{_UPPER}[^\W\d_]+"
_PARTICLE = "(?:von|van|der|den|de|del|della|di|da|dos|du|la|le|zu|zur|zum|ten|ter|bin|ibn|al|el|y)"
_SURNAME = rf"(?:{_PARTICLE}[ ]){{0,3}}{_WORD}(?:-{_WORD})*"
_NAME = rf"(?:{_UPPER}\.[ ]?|{_UPPER}[ ])*{_SURNAME}(?:(?:[ ]{_UPPER}\.?)*[ ]{_SURNAME}){{0,2}}"

# Tried in this order; the group named e is the entity.
KINDS = {
    "secret": r"(?i:token|secret|password|passwd|api[_-]?key|auth)\w*[\"']?\s*[=:]\s*[\"'](?P<e>[^\"'\s]{6,})",
    "token": r"(?<!\w)(?P<e>AKIA[0-9A-Z]{16}|gh[pousr]_\w{36}|xox[abprs]-[\w-]{10,}|sk-[\w-]{20,})(?!\w)",
    "hex": r"(?<![\w])(?P<e>[0-9a-f]{32,}|[0-9A-F]{32,})(?!\w)",
    "email": r"(?P<e>[\w+%-]+(?:\.[\w+%-]+)*@[\w-]+(?:\.[\w-]+)+)",
    "ip": r"(?<![\w.])(?P<e>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?!\w|\.\d)",
    "iban": r"(?<!\w)(?P<e>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)",
    "card": r"(?<![\w+])(?P<e>\d(?:[ -]?\d){12,18})(?!\w)",
    "phone": r"(?<!\w)(?P<e>\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}"
    r"|\(\d{2,4}\) ?\d{3}[ .-]\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w)",
    "ssn": r"(?<!\w)(?P<e>\d{3}-\d{2}-\d{4})(?!\w)",
    "name": rf"(?<!\w)(?<!\d )(?P<t>{_TITLE})\.?[ ](?P<e>{_NAME})",
}
_PATTERNS = {k: re.compile(p) for k, p in KINDS.items()}
_NAME_WORD = re.compile(rf"(?<!\w){_WORD}")
_NAME_PART = re.compile(rf"(?<!\w)(?:{_WORD}|{_UPPER}(?!\w))")
_MAYBE = re.compile(rf"[\d@=:]|(?<!\w){_TITLE}\.? |xox|sk-|AKIA|gh[pousr]_")
_TYPES = {"token": "secret", "hex": "secret"}  # found in other ways, one type
_OPENS = re.compile(r"(?:^|[.!?:;\n]['\"»”)]*\s+|\n)$")


def find(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of every entity, in order, without overlaps."""
    if not text or not _MAYBE.search(text):
        return []
    taken: list[tuple[int, int, str, str]] = []
    known: set[str] = set()
    for name, pattern in _PATTERNS.items():
        kind = _TYPES.get(name, name)
        new = [(*m.span("e"), kind, normal(kind, m["e"])) for m in pattern.finditer(text)]
        new = _free(new, taken)
        if kind == "name":
            known = {normal(kind, w) for a, b, _, _ in new for w in _NAME_WORD.findall(text[a:b])}
        taken = sorted(taken + new)
        if name == "hex":  # all secrets are known now
            values = {v for _, _, k, v in taken if k == kind}
            taken = sorted(taken + _free(_bare(text, values), taken)) if values else taken
    if known:
        words = [
            m.span()
            for m in _NAME_WORD.finditer(text)
            if normal("name", m[0]) in known and not _opening_word(text, m)
        ]
        words = _free([(a, b, "name", "") for a, b in words], taken)
        spans: list[list[int]] = []
        for a, b, _, _ in words:  # words that follow each other are one mention
            if spans and (text[spans[-1][1] : a] in (" ", "-") or _JOINT.fullmatch(text[spans[-1][1] : a])):
                spans[-1][1] = b
            else:
                spans.append([a, b])
        taken += _free([(a, b, "name", normal("name", text[a:b])) for a, b in spans], taken)
    return sorted(taken)


def _bare(text: str, values: set[str]) -> list[tuple[int, int, str, str]]:
    """Mentions of known secrets."""
    longest_first = sorted(values, key=lambda v: (-len(v), v))
    pattern = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, longest_first))})(?!\w)")
    return [(*m.span(), "secret", m[0]) for m in pattern.finditer(text)]


def _opening_word(text: str, m: re.Match) -> bool:
    """Whether a word of AMBIGUOUS opens a sentence and a word in small letters follows."""
    if m[0].lower() not in AMBIGUOUS or not re.match(r"\s+(?:I\b|[^\W\dA-Z])", text[m.end() : m.end() + 8]):
        return False
    return bool(_OPENS.search(text[max(0, m.start() - 8) : m.start()]))


_JOINT = re.compile(rf"(?:[ ]{_UPPER}\.?)+[ ]")


def _free(new: list, taken: list) -> list:
    """Those of new that overlap none of taken, which is in order."""
    starts = [x for x, _, _, _ in taken]

    def free(a, b):
        at = bisect_right(starts, a)
        return (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= starts[at])

    return [e for e in new if free(e[0], e[1])]


def name_words(text: str, a: int, b: int) -> list[tuple[str, str]]:
    """(kind, word) of a name in the text: the kind of a given name ends in the title's gender."""
    title = _TITLE_BEFORE.search(text[max(0, a - 40) : a])
    words = list(_NAME_WORD.finditer(text[a:b]))
    last = max(text.rfind(" ", a, b) + 1 - a, 0)
    gender = _GENDER.get(title[1].lower(), "n") if title else ""
    return [("name" + (gender if m.start() < last else ""), normal("name", m[0])) for m in words]


_TITLE_BEFORE = re.compile(rf"(?<!\w)({_TITLE})\.?[ ]$")


def normal(kind: str, surface: str) -> str:
    if kind in ("card", "phone", "ssn"):
        return re.sub(r"\D", "", surface)
    if kind == "iban":
        return surface.replace(" ", "")
    if kind in ("email", "name"):
        return unicodedata.normalize("NFC", surface).lower()
    return surface


class _Stream:
    """Keyed numbers without end."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.seed, self.count, self.left = key, "\0".join(parts), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 8:
            message = f"{self.seed}\0{self.count}".encode("utf-8", "replace")
            self.left += hmac.new(self.key, message, hashlib.sha256).digest()
            self.count += 1
        x, self.left = int.from_bytes(self.left[:8], "big"), self.left[8:]
        return x % n


_POOLS = [
    "abcdefghijklmnopqrstuvwxyz",
    "àáâãäåæçèéêëìíîïñòóôõöøùúûüý",
    "абвгдежзийклмнопрстуфхцчшщыэюя",
    "αβγδεζηθικλμνξοπρστυφχψω",
]


def _letter(c: str, draw: _Stream) -> str:
    for pool in _POOLS:
        if c.lower() in pool:
            x = pool[draw.below(len(pool))]
            return x.upper() if c.isupper() else x
    if "一" <= c <= "鿿":
        return chr(0x4E00 + draw.below(0x5000))
    return c


def _same_format(value: str, draw: _Stream, hexadecimal: bool = False) -> str:
    digits = "0123456789abcdef" if hexadecimal else "0123456789"
    out = []
    for c in value:
        if hexadecimal and c in "0123456789abcdefABCDEF":
            x = digits[draw.below(16)]
            out.append(x.upper() if c.isupper() else x)
        elif c.isdigit():
            out.append(str(draw.below(10)))
        else:
            out.append(_letter(c, draw))
    return "".join(out)


def luhn(digits: str) -> int:
    """0 for a valid number; else what the last digit lacks."""
    odd = [int(d) for d in digits[-1::-2]]
    even = [2 * int(d) for d in digits[-2::-2]]
    return (sum(odd) + sum(d - 9 if d > 9 else d for d in even)) % 10


def iban_rest(value: str) -> int:
    """1 for valid check digits."""
    moved = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """Normal form of the replacement; depends on its arguments only."""
    draw = _Stream(key, kind, value, str(attempt))
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "secret" and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        return _same_format(value, draw, hexadecimal=True)
    if kind == "email":
        name, _, domain = value.rpartition("@")
        host, dot, top = domain.rpartition(".")
        return f"{_same_format(name, draw)}@{_same_format(host, draw)}{dot}{top}"
    if kind == "card":
        made = value[0] + _same_format(value[1:], draw)
        if luhn(value) == 0:
            made = made[:-1] + str((int(made[-1]) - luhn(made)) % 10)
        return made
    if kind == "iban":
        made = _same_format(value[4:], draw)
        if iban_rest(value) != 1:  # not valid either
            return value[:2] + _same_format(value[2:4], draw) + made
        return f"{value[:2]}{98 - iban_rest(value[:2] + '00' + made):02d}{made}"
    if kind == "phone":
        country = 0  # the code stands in front of numbers longer than a national one
        if len(value) > 10:
            country = next((n for n in (1, 2) if value[:n] in CALLING), 3)
        return value[:country] + _same_format(value[country:], draw)
    if kind.startswith("name"):
        return _name(kind[4:], value, draw, attempt)
    return _same_format(value, draw)


def _name(gender: str, value: str, draw: _Stream, attempt: int) -> str:
    """One word of a name; ``gender`` is empty unless the word is a given name."""
    script = "latin"
    if re.search("[а-яё]", value):
        script = "cyrillic"
    elif re.search("[α-ωά-ώ]", value):
        script = "greek"
    parts = SYLLABLES[script].split()
    given = GIVEN[script, gender].split() if gender else []
    more = 3 + attempt
    if given:  # the lists are short: later attempts make longer names of them
        more = attempt if attempt > 1 else 0
    start = given[draw.below(len(given))].lower() if given else ""
    return start + "".join(parts[draw.below(len(parts))] for _ in range(more))


@lru_cache(16)
def initials(key: bytes) -> dict[str, str]:
    """A permutation of the letters of every alphabet."""
    out = {}
    for pool in _POOLS:
        draw, left = _Stream(key, "initials", pool), list(pool)
        for c in pool:
            out[c] = left.pop(draw.below(len(left)))
    return out


def rendered_name(key: bytes, surface: str, made: dict[tuple[str, str], str]) -> str:
    letters = initials(key)

    def one(m: re.Match) -> str:
        if len(m[0]) == 1:
            return letters.get(m[0].lower(), m[0].lower()).upper()
        new = made["name", normal("name", m[0])]
        return new.upper() if m[0].isupper() else new.capitalize()

    return _NAME_PART.sub(one, surface)


def rendered(kind: str, surface: str, made: str) -> str:
    """The replacement in the format of one spelling."""
    if kind in ("card", "phone", "ssn"):
        left = iter(made)
        return "".join(next(left) if c.isdigit() else c for c in surface)
    if kind == "iban":
        left = iter(made)
        return "".join(c if c == " " else next(left) for c in surface)
    if kind == "email":
        return "".join(m.upper() if c.isupper() else m for c, m in zip(surface, made))
    return made


def surrogate_table(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, made) for distinct (kind, value), free of collisions; kinds of names are
    checked together and become one."""

    def drawn(attempt: int):
        @F.pandas_udf("string")
        def run(kind: pd.Series, value: pd.Series) -> pd.Series:
            return pd.Series([surrogate(key, k, v, attempt) for k, v in zip(kind, value)])

        return run("how", "value")

    kind = F.when(F.col("kind").startswith("name"), "name").otherwise(F.col("kind"))
    todo = entities.select(kind.alias("kind"), F.col("kind").alias("how"), "value")
    real = todo.select("kind", F.col("value").alias("made"))
    done = None
    for attempt in range(MAX_ROUNDS):
        made = spool(todo.withColumn("made", drawn(attempt)), "drawn")
        used = real if done is None else real.union(done.select("kind", "made"))
        clash = used.distinct().withColumn("clash", F.lit(True))
        first = made.groupBy("kind", "made").agg(F.min("value").alias("first"))
        first = first.join(clash, ["kind", "made"], "left")
        judged = spool(made.join(first, ["kind", "made"]), "surrogates")
        fine = F.col("clash").isNull() & (F.col("first") == F.col("value"))
        good = judged.filter(fine).select("kind", "value", "made")
        done = good if done is None else done.union(good)
        todo = judged.filter(~fine).select("kind", "how", "value")
        if todo.isEmpty():
            return done
    raise RuntimeError("too many entities of one format to keep their surrogates distinct")


def replace_entities(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``docs`` with the text rewritten, and n_entities, n_distinct and kinds added."""
    small_batches(docs.sparkSession)

    # found: every mention; keys: what needs a surrogate, names word by word
    span = "array<struct<first:int,end:int,kind:string,value:string>>"
    pair = "array<struct<kind:string,value:string>>"

    @F.pandas_udf(f"found {span}, keys {pair}")
    def entities(s: pd.Series) -> pd.DataFrame:
        out = []
        for t in s:
            found = find(t if isinstance(t, str) else None)
            keys = {}
            for a, b, k, v in found:
                keys |= dict.fromkeys(name_words(t, a, b) if k == "name" else [(k, v)])
            spans = [dict(zip(("first", "end", "kind", "value"), e)) for e in found]
            out.append([spans, [{"kind": k, "value": v} for k, v in keys]])
        return pd.DataFrame(out, columns=["found", "keys"])

    @F.pandas_udf("string")
    def rewrite(s: pd.Series, spans: pd.Series, known: pd.Series) -> pd.Series:
        out = []
        for t, found, pairs in zip(s, spans, known):
            made = {(p["kind"], p["value"]): p["made"] for p in pairs}
            at, parts = 0, []
            for e in found:
                kind, surface = e["kind"], t[e["first"] : e["end"]]
                if kind == "name":
                    new = rendered_name(key, surface, made)
                else:
                    new = rendered(kind, surface, made[kind, e["value"]])
                parts += [t[at : e["first"]], new]
                at = e["end"]
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out)

    added = ["pii", "pii_found", "pii_keys", "pii_text", "pii_known", "pii_any"]
    added += ["n_entities", "n_distinct", "kinds"]
    found = docs.drop(*added).withColumn("pii", entities(F.col(text)))
    found = found.select(
        *docs.drop(*added).columns,
        F.col("pii.found").alias("pii_found"),
        F.col("pii.keys").alias("pii_keys"),
        (F.size("pii.found") > 0).alias("pii_any"),
    )
    found = spool(found, "searched")
    have, free = found.filter("pii_any"), found.filter(~F.col("pii_any"))
    have = have.withColumn("pii_text", F.xxhash64(text))
    free = free.drop("pii_keys", "pii_any")
    seen = have.select("pii_text", F.explode("pii_keys").alias("e"))
    seen = spool(seen.select("pii_text", "e.kind", "e.value").distinct(), "entities")
    # a word of names is a given name if it was one anywhere, of a gender if its titles agree
    kind = F.when(F.col("kind").startswith("name"), "name").otherwise(F.col("kind"))
    gender = F.when(F.col("kind").startswith("name"), F.substring("kind", 5, 1))
    sure = F.collect_set(F.when(gender.isin("m", "f"), gender)).alias("sure")
    per_word = seen.groupBy(kind.alias("kind"), "value").agg(sure, F.max(gender).alias("any"))
    how = F.when(F.size("sure") == 1, F.col("sure")[0]).when(F.col("any") != "", "n").otherwise("")
    wanted = per_word.select(F.concat("kind", how).alias("kind"), "value")
    seen = seen.select("pii_text", kind.alias("kind"), "value").distinct()
    table = surrogate_table(spool(wanted, "wanted"), key)
    per_text = (
        seen.join(table, ["kind", "value"])
        .groupBy("pii_text")
        .agg(F.collect_list(F.struct("kind", "value", "made")).alias("pii_known"))
    )
    made = rewrite(F.col(text), F.col("pii_found"), F.col("pii_known"))
    new = have.join(per_text, "pii_text").withColumn(text, made)
    both = new.select(*docs.drop(*added).columns, "pii_found").unionByName(free)
    entity = F.transform("pii_found", lambda e: F.struct(e["kind"], e["value"]))
    kinds = F.array_sort(F.array_distinct(F.transform("pii_found", lambda e: e["kind"])))
    return both.withColumns(
        {
            "n_entities": F.size("pii_found"),
            "n_distinct": F.size(F.array_distinct(entity)),
            "kinds": kinds,
        }
    ).drop("pii_found")
