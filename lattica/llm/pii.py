"""Personal data and secrets replaced by keyed surrogates of the same type, format, script and gender."""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import materialize, ship, tidied

#: Draws for an entity, after which a value space counts as used up.
DRAWS = 64

# First names by script and gender, and the titles that go before names.
FIRST_NAMES = {
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Sandra Ashley Kimberly Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca".split(),
    ("latin", "m"): "James Robert John Michael David William Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Donald Steven Andrew Kenneth Joshua George Kevin Brian Edward Ronald".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Светлана Татьяна Екатерина Юлия Людмила Галина".split(),
    ("cyrillic", "m"): "Александр Сергей Дмитрий Андрей Алексей Иван Михаил Николай Владимир Павел Виктор Борис".split(),
    ("greek", "f"): "Ελένη Κατερίνα Βασιλική Σοφία Αγγελική Γεωργία Δήμητρα Ειρήνη".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Κώστας Νίκος Παναγιώτης Χρήστος Βασίλης Ανδρέας".split(),
}
TITLES = {
    "Mr": "m", "Sir": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Don": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Doña": "f", "Dr": "", "Prof": "",
    "Господин": "m", "Госпожа": "f",
}
_GENDER = {name: (script, gender) for (script, gender), names in FIRST_NAMES.items() for name in names}
#: Made-up names: syllables of a first letter, a vowel and a last letter, by script.
_LETTERS = {"latin": ("bcdfghklmnprstvw", "aeiou", "lnrst"), "cyrillic": ("бвгдзклмнпрстф", "аеиоу", "лнрст"), "greek": ("βγδζθκλμνπρσ", "αειου", "λνρ")}
_SYLLABLES = {script: [a + b + c for a in x for b in y for c in z] for script, (x, y, z) in _LETTERS.items()}
#: Endings of made-up given names by script and gender.
_ENDINGS = {("latin", "f"): "a", ("latin", "m"): "o", ("cyrillic", "f"): "а", ("cyrillic", "m"): "", ("greek", "f"): "α", ("greek", "m"): "ος"}

_NAME = r"[^\W\d_a-zа-яα-ωß-öø-ÿά-ώ][^\W\d_A-ZА-ЯΑ-Ω]+"
_PATTERNS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])|(?<=-----BEGIN PRIVATE KEY-----)[A-Za-z0-9+/=\s]+(?=-----END PRIVATE KEY-----)")),
    ("secret", re.compile(r"(?i:(?<![A-Za-z])(?:api[_-]?key|token|secret|password|passwd)\s?[:=]\s?[\"']?)([A-Za-z0-9+/_.~-]{12,})")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("ssn", re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")),
    ("card", re.compile(r"(?<![0-9.,-])(?:(?:[0-9]{4}[ -]){3}[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9])")),
    ("ip", re.compile(r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])")),
    ("ip6", re.compile(r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:]|\.[0-9])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z.,-])0[0-9]{2,4}[ -][0-9]{3,4}[ -][0-9]{3,4}(?![0-9])|(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9A-Za-z])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")),
]
_WORTH = re.compile(r"[0-9@]")
_LONG_KEY = re.compile(r"(?i)api[_-]?key|token|secret|passw|BEGIN PRIVATE|[A-F]{32}|[A-Fa-f0-9]{32}")
_TITLED = re.compile(r"\b(" + "|".join(TITLES) + rf")(\.? )({_NAME}(?:-{_NAME})?)(?:( )({_NAME}(?:-{_NAME})?))?")
_CUE = re.compile(r"\b(?:[Mm]y name is|[Ii]ch hei(?:ß|ss)e|[Mm]ein Name ist|[Mm]e llamo|[Mm]i nombre es|[Jj]e m'appelle|[Mm]on nom est|[Nn]ame:|[Nn]ombre:|[Nn]om:|[Aa]uthor:|[Ss]igned:|[Cc]ontact:|[Мм]еня зовут) " + rf"({_NAME}(?:-{_NAME})?)(?: ({_NAME}(?:-{_NAME})?))?")
_NAMED = re.compile(r"\b(" + "|".join(_GENDER) + rf")( )({_NAME}(?:-{_NAME})?)")


#: The least and the most digits of an entity.
_DIGITS = {"card": (13, 19), "phone": (7, 15)}


def _is_ip6(value: str) -> bool:
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return False
    return True


def script_of(name: str) -> str:
    c = name[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def _canonical(kind: str, value: str) -> str:
    if kind == "email":
        return value.lower()
    if kind in ("card", "phone"):
        return re.sub(r"[^0-9+]", "", value)
    if kind == "ip6":
        return ipaddress.IPv6Address(value).exploded
    return value.replace(" ", "") if kind == "iban" else value


def _surname_key(name: str, gender: str) -> str:
    """A woman's and a man's form of a Slavic surname are one family name."""
    if gender == "f" and name.endswith(("ова", "ева", "ova", "eva")):
        return name[:-1]
    return name


def find_entities(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, stop, kind, value, extra) of the entities of a text, in order and apart; extra: a name's gender, else empty."""
    found: list[tuple[int, int, str, str, str]] = []
    if _WORTH.search(text) or _LONG_KEY.search(text):
        for kind, pattern in _PATTERNS:
            if kind == "email" and "@" not in text:
                continue
            for m in pattern.finditer(text):
                start, stop = m.span(m.lastindex or 0)
                if kind in _DIGITS and not _DIGITS[kind][0] <= sum(c.isdigit() for c in text[start:stop]) <= _DIGITS[kind][1]:
                    continue
                if kind == "ip6" and not _is_ip6(text[start:stop]):
                    continue
                if kind == "secret" and not re.search(r"[0-9]", text[start:stop]):
                    continue
                found.append((start, stop, kind, text[start:stop], ""))
    for m in _TITLED.finditer(text):
        first, last = m[3], m[5]
        gender = TITLES[m[1]] or _GENDER.get(first, ("", ""))[1]
        if last:
            found += [(*m.span(3), "first" if first in _GENDER else f"given-{gender}", first, gender), (*m.span(5), "surname", last, gender)]
        else:
            found.append((*m.span(3), "first" if first in _GENDER else "surname", first, gender))
    for m in _CUE.finditer(text):
        gender = _GENDER.get(m[1], ("", ""))[1]
        found.append((*m.span(1), "first" if m[1] in _GENDER else f"given-{gender}", m[1], gender))
        if m[2]:
            found.append((*m.span(2), "surname", m[2], gender))
    found += [x for m in _NAMED.finditer(text) for x in ((*m.span(1), "first", m[1], _GENDER[m[1]][1]), (*m.span(3), "surname", m[3], _GENDER[m[1]][1]))]
    if surnames := {x[3]: x[4] for x in found if x[2] == "surname"}:  # the same name alone, elsewhere in the text
        alone = re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(surnames, key=len, reverse=True))) + r")\b")
        found += [(*m.span(), "surname", m[0], surnames[m[0]]) for m in alone.finditer(text)]
    found.sort(key=lambda x: x[0])  # stable: of those that start together, the first pattern's
    apart, end = [], 0
    for x in found:
        if x[0] >= end:
            apart.append(x)
            end = x[1]
    return apart


class Surrogates:
    """Draws surrogates from a secret key: the same entity and draw always give the same one."""

    def __init__(self, key: bytes):
        self.key = key

    def numbers(self, *parts: str) -> Iterator[int]:
        seed = hmac.new(self.key, "\0".join(parts).encode(), hashlib.sha256).digest()
        for turn in range(1 << 30):
            yield from hashlib.sha256(seed + turn.to_bytes(4, "little")).digest()

    def _shape(self, value: str, source: Iterator[int], hexadecimal: bool = False) -> str:
        out = []
        for c in value:
            letters = "0123456789" if c in "0123456789" else "abcdefghijklmnopqrstuvwxyz" if "a" <= c <= "z" else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if "A" <= c <= "Z" else ""
            if hexadecimal and letters:
                letters = "0123456789ABCDEF" if value.upper() == value else "0123456789abcdef"
            out.append(letters[(next(source) << 8 | next(source)) % len(letters)] if letters else c)
        return "".join(out)

    def value(self, kind: str, canonical: str, draw: int) -> str:
        """The canonical surrogate of a canonical value."""
        source = self.numbers(kind, canonical, str(draw))
        if kind == "email":
            local, _, domain = canonical.rpartition("@")
            host, _, top = domain.rpartition(".")
            more = f"{draw}" if draw else ""
            return f"{self._shape(local, source)}{more}@{self._shape(host, self.numbers('domain', host))}.{top}"
        if kind == "secret":
            prefix = next((x for x in ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-") if canonical.startswith(x)), "")
            rest = canonical[len(prefix) :]
            return prefix + self._shape(rest, source, bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", rest)))
        if kind == "card":
            digits = canonical[0] + self._shape(canonical[1:-1], source)
            right = next(c for c in "0123456789" if luhn(digits + c))
            return digits + (right if luhn(canonical) else str((int(right) + 1 + next(source) % 9) % 10))
        if kind == "iban":
            body = self._shape(canonical[4:], source)
            return f"{canonical[:2]}{98 - int(''.join(str(int(c, 36)) for c in body + canonical[:2] + '00')) % 97:02d}{body}"
        if kind == "ssn":
            a, b, c = (next(source) << 16 | next(source) << 8 | next(source) for _ in range(3))
            area = 1 + a % 898
            return f"{area + (area >= 666):03d}-{1 + b % 99:02d}-{1 + c % 9999:04d}"
        if kind == "ip":
            old = ipaddress.ip_address(canonical)
            nets = [ipaddress.ip_network(x) for x in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "0.0.0.0/0")]
            net = next(n for n in nets if old in n)
            while True:
                x = int.from_bytes(bytes(next(source) for _ in range(4)), "big")
                new = ipaddress.ip_address(int(net.network_address) + x % net.num_addresses)
                if next(n for n in nets if new in n) == net and not (new.is_multicast or new.is_reserved or new.is_unspecified):
                    return str(new)
        if kind == "ip6":  # groups of zeros stay, so a shortened form stays one; others keep their length
            return ":".join(g if not int(g, 16) else self._group(g, source) for g in canonical.split(":"))
        if kind == "phone":
            code = canonical[:2] if canonical.startswith("+1") else canonical[:3] if canonical.startswith("+") else canonical[:1] if canonical.startswith("0") else ""
            rest = self._shape(canonical[len(code) :], source)
            return code + (rest if rest[:1] != "0" else str(1 + next(source) % 9) + rest[1:])
        if kind == "first":
            names = FIRST_NAMES[_GENDER[canonical]]
            order = sorted(names, key=lambda n: hmac.new(self.key, n.encode(), hashlib.sha256).digest())
            return order[(order.index(canonical) + 1) % len(order)]  # a cycle: no name is its own surrogate, no two share one
        script = script_of(canonical)
        if kind.startswith("given"):
            return (self._made_up(script, 2 + draw // 4, source) + _ENDINGS[script, kind[6:] or "fm"[next(source) % 2]]).capitalize()
        stem = self._made_up(script, 2 + draw // 4, source)
        if script == "cyrillic":
            return (stem + ("ов" if canonical.endswith(("ов", "ев", "ин")) else "енко")).capitalize()
        return (stem + ("ov" if canonical.endswith(("ov", "ev")) else "")).capitalize()

    def _made_up(self, script: str, n: int, source: Iterator[int]) -> str:
        syllables = _SYLLABLES[script]
        return "".join(syllables[(next(source) << 8 | next(source)) % len(syllables)] for _ in range(n))

    def _group(self, group: str, source: Iterator[int]) -> str:
        size = len(group.lstrip("0"))
        low = 16 ** (size - 1)
        return f"{low + (next(source) << 8 | next(source)) % (15 * low):04x}"

    def shown(self, kind: str, value: str, gender: str, surrogate: str) -> str:
        """The surrogate as it stands in the text: with the separators of the value, and the form for a gender."""
        if kind in ("card", "phone", "iban"):
            source = iter(surrogate)
            return "".join(next(source) if c.isalnum() or c == "+" else c for c in value)
        if kind == "email" and value.upper() == value and value.lower() != value:
            return surrogate.upper()
        if kind == "ip6":
            short = surrogate if len(value) == 39 else ipaddress.IPv6Address(surrogate).compressed if "::" in value else ":".join(f"{int(g, 16):x}" for g in surrogate.split(":"))
            return short.upper() if value.upper() == value and value.lower() != value else short
        if kind == "surname" and gender == "f" and value.endswith(("ова", "ева", "ova", "eva")) and surrogate.endswith(("ов", "ov")):
            return surrogate + ("а" if surrogate.endswith("ов") else "a")
        return surrogate


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _keyed(kind: str, value: str, gender: str) -> str:
    return _surname_key(value, gender) if kind == "surname" else _canonical(kind, value)


def surrogate_table(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canonical, draw, surrogate) for the distinct entities, surrogates distinct within a kind.

    A draw that another entity also has, or that is itself an entity of the texts, is drawn again but
    for the first entity of a shared one, until no clash is left. First names are permuted within their
    script and gender, so they never clash. The rows are entities, not documents: a value that a
    third of all documents hold is one row.
    """
    surrogates = Surrogates(key)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [surrogates.value(*x) for x in zip(*[c.to_pylist() for c in batch.columns])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], ["kind", "canonical", "draw", "surrogate"])

    ddl = "kind string, canonical string, draw int, surrogate string"
    n = entities.count()
    known = materialize(entities.select("kind", "canonical").distinct().withColumn("draw", F.lit(0)).mapInArrow(tidied(draw), ddl), "surrogates", n)
    originals = known.select("kind", F.col("canonical").alias("surrogate")).where("kind != 'first'").withColumn("taken", F.lit(True))
    for turn in range(1, DRAWS):
        order = Window.partitionBy("kind", "surrogate").orderBy("draw", "canonical")
        ranked = known.withColumn("again", F.when(F.col("kind") == "first", False).otherwise(F.row_number().over(order) > 1))
        ranked = ranked.join(originals, ["kind", "surrogate"], "left")
        again = F.col("again") | F.coalesce("taken", F.lit(False)) | ((F.col("canonical") == F.col("surrogate")) & (F.col("kind") != "first"))
        ranked = materialize(ranked.select("kind", "canonical", "draw", "surrogate", again.alias("again")), "ranked", n)
        clashing = ranked.where("again")
        if clashing.isEmpty():
            return known
        redrawn = clashing.select("kind", "canonical", F.lit(turn).alias("draw")).mapInArrow(tidied(draw), ddl)
        known = materialize(ranked.where("not again").drop("again").unionByName(redrawn), "surrogates", n)
    raise ValueError(f"no distinct surrogates after {DRAWS} draws")


def replaced(text: str, entities: list, surrogates: Surrogates, moved: dict[tuple[str, str], str]) -> str:
    """``text`` with its entities' surrogates: of ``moved`` those that had to be drawn again, of others the first draw."""
    parts, end = [], 0
    for start, stop, kind, value, extra in entities:
        canonical = _keyed(kind, value, extra)
        surrogate = moved.get((kind, canonical)) or surrogates.value(kind, canonical, 0)
        parts += [text[end:start], surrogates.shown(kind, value, extra, surrogate)]
        end = stop
    return "".join(parts) + text[end:]


_FOUND = "array<struct<kind:string,canonical:string>>"


def searched_texts(docs: DataFrame, surrogates: Surrogates, text_col: str = "text") -> DataFrame:
    """(row, new, n, found) for each row: its columns, the text replaced by first draws (null without entities), the number of entities, and the distinct ones."""
    pairs = pa.list_(pa.struct([("kind", pa.string()), ("canonical", pa.string())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, counts, found = [], [], []
            for x in batch.column(1):
                text = x.as_py()
                entities = find_entities(text) if text else []
                new.append(replaced(text, entities, surrogates, {}) if entities else None)
                counts.append(len(entities))
                found.append([{"kind": k, "canonical": c} for k, c in sorted({(kind, _keyed(kind, value, extra)) for _, _, kind, value, extra in entities})])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string()), pa.array(counts, pa.int64()), pa.array(found, pairs)], ["row", "new", "n", "found"])

    ship(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = rows.select("row", F.lit(None).cast("string").alias("new"), F.lit(0).cast("long").alias("n"), F.array().cast(_FOUND).alias("found")).schema
    return rows.mapInArrow(tidied(search), schema)


def entity_table(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, canonical): the distinct entities of each row; nothing for null and empty texts."""
    return searched_texts(docs, Surrogates(b""), text_col).select(F.explode("found").alias("e")).select("e.*")


def replace_entities(docs: DataFrame, key: bytes, text_col: str = "text", count_col: str | None = "n_entities") -> DataFrame:
    """The columns of ``docs`` with entities replaced in the text, and their number in ``count_col``, which replaces a column of that name.

    The same entity has the same surrogate in all texts, different ones have different ones; texts
    without entities, and all other text, stay as they are, null and empty texts too. First draws are functions of
    the key and the entity; later ones, where two entities or a value of the texts clash, depend on what else is there.
    Texts are searched once and replaced by first draws at once; only texts with an entity that had to be drawn
    again are searched a second time, with their own redrawn surrogates joined to them. Repeated rows and rows
    of one doc_id are each replaced; an empty table gives no rows.
    """
    columns = [c for c in docs.columns if c.lower() != (count_col or "").lower()]
    docs = docs.select(*columns)
    surrogates = Surrogates(key)
    searched = materialize(searched_texts(docs, surrogates, text_col).withColumn("k", F.monotonically_increasing_id()), "searched")
    every = searched.where("n > 0").select("k", F.explode("found").alias("e")).select("k", "e.kind", "e.canonical")
    moved = materialize(surrogate_table(every, key).where("draw > 0"), "moved", every.count())
    done = searched.select("row", "new", "n")
    if not moved.isEmpty():
        own = every.join(moved, ["kind", "canonical"]).groupBy("k").agg(F.collect_set(F.struct("kind", "canonical", "surrogate")).alias("own"))

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                new = []
                for x, first, mine in zip(batch.column(3), batch.column(1), batch.column(4)):
                    text, mine = x.as_py(), mine.as_py()
                    new.append(replaced(text, find_entities(text), surrogates, {(e["kind"], e["canonical"]): e["surrogate"] for e in mine}) if mine else first.as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string()), batch.column(2)], ["row", "new", "n"])

        some = searched.where("n > 0").join(own, "k", "left").select("row", "new", "n", F.col("row").getField(text_col).cast("string").alias("text"), "own")
        done = searched.where("n = 0").select("row", "new", "n").unionByName(some.mapInArrow(tidied(again), done.schema))
    text = F.coalesce("new", F.col("row").getField(text_col))
    out = [text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in columns]
    return done.select(*out, *([F.col("n").alias(count_col)] if count_col else []))
