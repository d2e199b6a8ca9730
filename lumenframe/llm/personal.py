"""Personal information in free text, found by bootstrapped contextual extraction.

1. Candidates: every span that could be an e-mail address, a number of a person, a street address or two parts of a
   name is taken out of each field together with its form (digits as 9, letters as classes) and its lexical context.
   Nothing known narrows them, but for names without capitals, which would be all pairs of words: of these, those whose
   words pass a filter of the known parts (one bit array of fixed size, whatever the number of parts) are candidates.
2. Bootstrapping over the graph of patterns and instances. For addresses, numbers and streets a few forms are seeds
   (e-mail addresses with signs for "at" and "dot", numbers with a country code, social-security-like numbers, known kinds
   of streets). Contexts in which mostly accepted forms stand are accepted, forms that mostly stand in accepted contexts
   are accepted, and so on. For names the table of known parts is the seed: pairs of known parts induce contexts, and an
   unseen part that stands beside several known ones in accepted contexts becomes known itself. Iterations work on
   aggregated graphs, not on texts.
3. Each candidate is judged by its form, its context and its parts; accepted ones are found or replaced.

No text is collected; the driver gets the bit array and counts.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.runtime import broadcast_if_small, materialize, stored

FIELDS = ("text", "window_title", "extra_context")
ROUNDS = 3
MIN_SUPPORT, MIN_CONFIDENCE = 2, 0.5
#: Seeds are only some of the true forms, so a context needs a smaller share of accepted ones than a form of contexts.
CONTEXT_CONFIDENCE = 0.2
BROADCAST_ROWS = 200_000
#: Bits of the filter of known parts: 128 kB. A filter that is full lets more candidates through, never fewer.
FILTER_BITS = 1 << 20

_L = r"[^\W\d_]"
EMAIL = re.compile(
    r"(?:<?mailto:)?(?<![\w.@+-])([\w](?:[\w.+-]*[\w])?) ?(?:@|\(at\)|\[at\]) ?"
    r"([a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:(?:\.|\[dot\]|\(dot\))[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)+)>?",
    re.I,
)
#: The same in words; an address only where its context says so.
SPOKEN = re.compile(r"(?<![\w.@+-])(\w[\w.+-]*) at ((?:[a-z0-9][a-z0-9-]*[ .](?:dot )?)*?[a-z0-9][a-z0-9-]* dot [a-z]{2,})(?![\w@])", re.I)
#: Endings of file names, which are no top-level domains.
FILE_ENDINGS = {"png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "bmp", "pdf", "txt", "csv", "json", "xml", "yaml", "yml", "toml", "md", "py", "js", "ts", "css", "html", "log", "sql", "zip", "gz", "tar", "exe", "dll", "so", "ini", "cfg", "conf", "sh"}
NUMBER = re.compile(
    r"(?<![\w.,:/@#-])(?:(tel|phone|mobile|fax|ssn|nino|dni|nie)\b[.:]? ?)?"
    r"(\+?\(?\d[\d ().\-/]{5,}\d(?: ext\.? \d+)?|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]-?\d{7,8}-?[A-Z]|\d{8}-?[A-Z])(?![\w@:])(?![-./]\w)",
    re.I,
)
_W = rf"{_L}+(?:['’-]{_L}+)*"
ADDRESS = re.compile(
    rf"(?<![\w./-])(?:(?:apt|flat|unit)\.? \d+[a-z]?, )?(?:"
    rf"(?P<n1>\d+[a-z]?),? (?P<pre>(?:rue|avenue|calle|via|place|boulevard|camino|plaza)) (?:(?:de|du|des|la|le|les|del|los|las) )*{_W}"
    rf"|(?P<n2>\d+[a-z]?) (?:{_W} ){{1,2}}?(?P<kind>{_L}{{2,}})\b\.?"
    rf"|(?P<pre3>(?:rue|avenue|calle|via|place|boulevard|camino|plaza)) (?:(?:de|du|des|la|le|les|del|los|las) )*{_W},? (?P<n3>\d+[a-z]?)"
    rf"|(?P<comp>{_L}{{4,}}) (?P<n4>\d+[a-z]?))(?![\w@])",
    re.I,
)
#: Kinds of streets that seed the search: words, and ends of compound words.
STREETS = {"street", "st", "road", "rd", "lane", "ln", "avenue", "ave", "drive", "dr", "boulevard", "blvd", "court", "ct", "square", "rue", "calle", "via"}
STREET_ENDS = ("straße", "strasse", "gasse", "weg", "platz", "allee")
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "herr", "frau", "mme", "sr", "sra", "re", "inbox", "chat"}
WORD = re.compile(rf"(?<![\w@.+/\\-])({_L}+(?:-{_L}+)*)(?![\w@+\\]|\.\w)")
CONTEXT = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")


def _context(line: str, start: int) -> str:
    """The two words or signs before ``start``, in lower case, numbers as 9; ^ where the line begins."""
    tokens = CONTEXT.findall(line[max(0, start - 48) : start].lower())[-2:]
    tokens = ["9" if t.isdigit() else t for t in tokens]
    return " ".join(["^"] * (2 - len(tokens)) + tokens)


def _form(value: str) -> str:
    return re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", value.strip().upper()))


def _capital(word: str) -> bool:
    return word[0].isupper() and len(word) > 1


def _names(line: str, base: int, may_be_part, out: list) -> None:
    """Candidates for names. Pairs that don't overlap teach contexts and parts; all others are judged only."""
    every = list(WORD.finditer(line))

    def add(form, a, b, start, end):
        out.append(("name", form, a.lower(), b.lower(), _context(line, start), base + start, base + end))

    for m, n in zip(every, every[1:]):
        a, b = m.group(), n.group()
        if not (a[0].isupper() and b[0].isupper()) and may_be_part(a) and may_be_part(b) and line[m.end() : n.start()] == " ":
            add("small", a, b, m.start(), n.end())
    words = [m for m in every if m.group()[0].isupper()]
    used = -1
    for i, (m, n) in enumerate(zip(words, words[1:])):
        first, second = m.group(), n.group()
        if first.lower() in TITLES:
            continue
        gap, dot = line[m.end() : n.start()], line[n.end() : n.end() + 1] == "."
        if len(first) == 1:
            if gap == ". " and _capital(second) and second.lower() not in TITLES and i > used:
                add("initial", first, second, m.start(), n.end())
            continue
        stop, part = n.end(), second
        if gap == " " and len(second) == 1 and i + 2 < len(words) and line[n.end() : words[i + 2].start()] in (". ", " "):
            part, stop = words[i + 2].group(), words[i + 2].end()
        if gap == " " and _capital(part):
            taught = i > used and first[1:].islower()
            add("pair" if taught else "beside", first, part, m.start(), stop)
            used = (i + 1 + (part is not second)) if taught else used
        elif gap == ", " and len(second) == 1 and dot:
            add("initial", second, first, m.start(), n.end() + 1)
        elif gap == ", " and _capital(second) and second.lower() not in TITLES:
            add("turned", second, first, m.start(), n.end())


def _candidates(value: str, may_be_part) -> list:
    out: list = []
    base = 0
    for line in value.split("\n"):
        low = line.lower() if "@" in line or "at" in line or "AT" in line or "At" in line else ""
        if "@" in low or "at)" in low or "at]" in low:
            for m in EMAIL.finditer(line):
                host = re.split(r"\.|\[dot\]|\(dot\)", m.group(2), flags=re.I)
                good = host[-1].isalpha() and len(host[-1]) > 1 and host[-1].lower() not in FILE_ENDINGS
                if good and not line[m.end() :].startswith((":~", ":/")):
                    signs = " ".join(dict.fromkeys(re.findall(r"@|[(\[]at[)\]]|[(\[]dot[)\]]", m.group().lower())))
                    out.append(("email", signs, m.group().lower(), "", _context(line, m.start()), base + m.start(), base + m.end()))
        if " at " in low and " dot " in low:
            for m in SPOKEN.finditer(line):
                context = _context(line, m.start())
                out.append(("email", f"spoken {context}", m.group().lower(), "", context, base + m.start(), base + m.end()))
        digits = sum(map(str.isdigit, line))
        if digits >= 6:
            for m in NUMBER.finditer(line):
                if sum(map(str.isalnum, m.group(2))) >= 7:
                    form = ((m.group(1) or "").lower() + " " + _form(re.sub(r"(?i) ext\.? \d+", " ext", m.group(2)))).strip()
                    out.append(("number", form, m.group(2), "", _context(line, m.start()), base + m.start(), base + m.end()))
        if digits:
            for m in ADDRESS.finditer(line):
                if m["comp"]:
                    if not m["comp"][0].isupper():
                        continue
                    form = "~" + m["comp"].lower()[-3:]
                else:
                    kind = (m["pre"] or m["pre3"] or m["kind"]).lower()
                    street = m.group().split()[-2] if m["kind"] else "X"
                    if m["kind"] and not (m["kind"][0].isupper() and street[0].isupper()):
                        continue
                    form = ("<" if m["pre"] or m["pre3"] else ">") + kind
                out.append(("address", form, m.group().lower(), "", _context(line, m.start()), base + m.start(), base + m.end()))
        _names(line, base, may_be_part, out)
        base += len(line) + 1
    return out


def _bit(word: str, size: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word.lower()) % size


def _part_bits(size: int):
    def run(batches):
        bits = bytearray(size // 8)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                if part:
                    at = _bit(part, size)
                    bits[at >> 3] |= 1 << (at & 7)
        yield pa.RecordBatch.from_arrays([pa.array([bytes(bits)], pa.binary())], names=["bits"])

    return run


def _part_filter(parts: DataFrame) -> bytes:
    """The filter of known parts; one array of FILTER_BITS bits a partition of the table reaches the driver, one after another."""
    bits = bytearray(FILTER_BITS // 8)
    for row in parts.select("name_part").mapInArrow(_part_bits(FILTER_BITS), "bits binary").toLocalIterator():
        bits = bytearray(x | y for x, y in zip(bits, row.bits))
    return bytes(bits)


def _extract(bits):
    def run(batches):
        seen: dict = {}

        def may_be_part(word):
            known = seen.get(word)
            if known is None:
                if len(seen) > 500_000:
                    seen.clear()
                at = _bit(word, 8 * len(bits.value))
                known = seen[word] = bool(bits.value[at >> 3] >> (at & 7) & 1)
            return known

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            rows: list = []
            for key, *values in zip(*columns):
                for field, value in zip(FIELDS, values):
                    if value:
                        rows += [(key, field, *c) for c in _candidates(value, may_be_part)]
            arrays = list(zip(*rows)) or [[]] * 9
            types = [pa.int64(), *[pa.string()] * 6, pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, types)], names=["k", "field", "cls", "form", "a", "b", "ctx", "start", "stop"])

    return run


_CANDIDATE = "k long, field string, cls string, form string, a string, b string, ctx string, start int, stop int"


def extract_candidates(frames: DataFrame, parts: DataFrame) -> DataFrame:
    """Checkpointed table of candidate spans of all fields: ``k, field, cls, form, a, b, ctx, start, stop``."""
    bits = frames.sparkSession.sparkContext.broadcast(_part_filter(parts))
    return stored(frames.select(F.col("id").cast("long").alias("k"), *FIELDS).mapInArrow(_extract(bits), _CANDIDATE))


def _bootstrap_forms(edges: DataFrame) -> DataFrame:
    """(cls, form, kind) accepted after ROUNDS passes over the graph ``cls, form, ctx, n, kind``; ``kind`` is that of seeds or null."""
    # A context of no word at all, the bare start of a line, says nothing.
    edges = materialize(edges.withColumn("ctx", F.when(F.col("ctx") != "^ ^", F.col("ctx"))))
    fixed = edges.where(F.col("kind").isNotNull()).select("cls", "form", "kind").distinct()
    plain, forms = edges.drop("kind"), fixed
    totals = materialize(plain.groupBy("cls", "ctx").agg(F.sum("n").alias("all")))
    weights = materialize(plain.groupBy("cls", "form").agg(F.sum("n").alias("all")))
    for _ in range(ROUNDS):
        hits = plain.join(forms, ["cls", "form"]).groupBy("cls", "ctx", "kind").agg(F.sum("n").alias("p")).join(totals, ["cls", "ctx"])
        contexts = hits.where((F.col("p") >= MIN_SUPPORT) & (F.col("p") > CONTEXT_CONFIDENCE * F.col("all"))).select("cls", "ctx", "kind")
        found = plain.join(contexts, ["cls", "ctx"]).groupBy("cls", "form", "kind").agg(F.sum("n").alias("p")).join(weights, ["cls", "form"])
        found = found.where((F.col("p") >= MIN_SUPPORT) & (F.col("p") > MIN_CONFIDENCE * F.col("all"))).select("cls", "form", "kind")
        forms = materialize(fixed.unionByName(found.join(fixed.select("cls", "form"), ["cls", "form"], "left_anti")))
    return forms


def _bootstrap_parts(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """(part, role) of known and newly accepted parts of names; ``pairs`` is ``form, a, b, ctx, n`` of name candidates."""
    role = F.when(F.lower("kind") == "given", "g").otherwise("s")
    known = parts.where("name_part is not null").select(F.lower("name_part").alias("part"), role.alias("role")).distinct()
    two = materialize(pairs.where(F.col("form") == "pair"))
    for _ in range(ROUNDS):
        given = known.where("role = 'g'").select(F.col("part").alias("a"), F.lit(1).alias("ga"))
        surname = known.where("role = 's'").select(F.col("part").alias("b"), F.lit(1).alias("sb"))
        marked = materialize(two.join(given, "a", "left").join(surname, "b", "left"))
        both = F.col("ga").isNotNull() & F.col("sb").isNotNull()
        context = marked.groupBy("ctx").agg(F.sum(F.when(both, F.col("n")).otherwise(0)).alias("p"), F.sum("n").alias("all"))
        good = context.where((F.col("p") >= MIN_SUPPORT) & (F.col("p") > CONTEXT_CONFIDENCE * F.col("all"))).select("ctx", F.lit(1).alias("gc"))
        seen = marked.join(good, "ctx", "left")

        def learn(side: str, other_known, mine_unknown, seen=seen):
            mine, other = ("b", "a") if side == "s" else ("a", "b")
            support = other_known & F.col("gc").isNotNull()
            scored = seen.where(mine_unknown & (F.length(mine) > 1)).groupBy(F.col(mine).alias("part")).agg(
                F.countDistinct(F.when(support, F.col(other))).alias("partners"),
                F.sum(F.when(other_known, F.col("n")).otherwise(0)).alias("p"),
                F.sum("n").alias("all"),
            )
            ok = (F.col("partners") >= MIN_SUPPORT) & (F.col("p") > MIN_CONFIDENCE * F.col("all"))
            return scored.where(ok).select("part", F.lit(side).alias("role"))

        new = learn("s", F.col("ga").isNotNull(), F.col("sb").isNull()).unionByName(learn("g", F.col("sb").isNotNull(), F.col("ga").isNull()))
        new = new.join(known.select("part").distinct(), "part", "left_anti")
        known = materialize(known.unionByName(new).distinct())
    return known


def personal_spans(frames: DataFrame, parts: DataFrame) -> DataFrame:
    """``id, field, kind, start, stop`` of each accepted span (offsets in code points, within the field's value)."""
    found = extract_candidates(frames, parts)
    edges = found.where(F.col("cls") != "name").groupBy("cls", "form", "ctx").agg(F.countDistinct("a").alias("n"))
    identity = r"^(?:ssn 9{9}|(?:ssn )?999-99-9999|(?:nino )?AA ?99 ?99 ?99 ?A|(?:nie |dni )?A9999999A)$"
    street = F.substring("form", 2, 40).isin(*STREETS) & ~F.col("form").startswith("~")
    compound = F.col("form").isin(*{"~" + end[-3:] for end in STREET_ENDS if end in ("weg", "straße", "strasse", "allee", "gasse", "platz")} - {"~sse", "~atz"})
    seed = (
        F.when(F.col("cls") == "email", F.when(~F.col("form").startswith("spoken"), "email"))
        .when(F.col("cls") == "number", F.when(F.col("form").rlike(r"^\+9"), "phone").when(F.col("form").rlike(identity), "id_number"))
        .otherwise(F.when(street | compound, "address"))
    )
    forms = _bootstrap_forms(edges.withColumn("kind", seed))
    names = found.where("cls = 'name'")
    pairs = materialize(names.groupBy("form", "a", "b", "ctx").agg(F.count(F.lit(1)).alias("n")))
    known = _bootstrap_parts(pairs, parts)
    size = known.count()
    given, surname = (broadcast_if_small(known.where(F.col("role") == r).select("part"), size, BROADCAST_ROWS) for r in "gs")
    # Judged once for each distinct pair of parts; a name in straight or turned order needs a given name and a surname.
    asked = pairs.select("form", "a", "b").distinct()
    for part in ("a", "b"):
        for role, table in (("g", given), ("s", surname)):
            asked = asked.join(table.select(F.col("part").alias(part), F.lit(True).alias(f"{part}_{role}")), part, "left")
    straight, turned = F.col("a_g") & F.col("b_s"), F.col("a_s") & F.col("b_g") & (F.col("form") != "turned")
    true = F.when(F.col("form") == "initial", F.col("b_s")).otherwise(F.coalesce(straight, F.lit(False)) | F.coalesce(turned, F.lit(False)))
    judged = materialize(asked.where(true).select("form", "a", "b"))
    names = names.join(broadcast_if_small(judged, judged.count(), BROADCAST_ROWS), ["form", "a", "b"])
    out = ["k", "field", "kind", "start", "stop"]
    accepted = found.where(F.col("cls") != "name").join(broadcast_if_small(forms, forms.count(), BROADCAST_ROWS), ["cls", "form"])
    spans = accepted.select(*out).unionByName(names.withColumn("kind", F.lit("name")).select(*out))
    return spans.withColumnRenamed("k", "id")


def personal_fields(frames: DataFrame, parts: DataFrame) -> DataFrame:
    """``id, field, kind``: one row per frame, field and kind of personal data it holds at least once.

    Null, empty and very long fields are handled as any other; a null id comes out as null. Rows that repeat another
    row under the same id give one row. An empty table of parts leaves names to nothing known, so none are found.
    """
    return personal_spans(frames, parts).select("id", "field", "kind").distinct()


def _replace(batches):
    for pdf in batches:
        out = {name: [] for name in FIELDS}
        for *values, spans in zip(*(pdf[name] for name in FIELDS), pdf["spans"]):
            by_field: dict = {}
            for span in [] if spans is None else spans:
                by_field.setdefault(span["field"], []).append((span["start"], span["stop"], span["kind"]))
            for name, value in zip(FIELDS, values):
                for start, stop, kind in _disjoint(by_field.get(name, [])):
                    value = value[:start] + f"[{kind.upper()}]" + value[stop:]
                out[name].append(value)
        yield pd.DataFrame({"id": pdf["id"], **out})


def _disjoint(spans: list) -> list:
    """Spans from last to first; of overlapping ones the longest stays."""
    kept: list = []
    for span in sorted(set(spans), key=lambda s: (s[0] - s[1], s)):
        if all(span[1] <= s[0] or span[0] >= s[1] for s in kept):
            kept.append(span)
    return sorted(kept, reverse=True)


def redact_personal(frames: DataFrame, parts: DataFrame) -> DataFrame:
    """``id, text, window_title, extra_context`` with typed placeholders such as [EMAIL]; every row comes out.

    Nulls stay null. Rows of one id share their spans, as rows that repeat another row do.
    """
    spans = personal_spans(frames, parts).groupBy("id").agg(F.collect_list(F.struct("field", "kind", "start", "stop")).alias("spans"))
    joined = frames.select(F.col("id").cast("long").alias("id"), *FIELDS).join(spans, "id", "left")
    return joined.mapInPandas(_replace, "id long, text string, window_title string, extra_context string")
