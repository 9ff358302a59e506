"""Legal citations in text, as arrays of structs with their places.

Citations are read token by token around the mark that gives them away: a section sign with a code's name before it and a
list of sections after it, or a "v." with a party on each side and year, volume, reporter and page behind them. Names of
codes and reporters are looked up in tables, by their letters alone, so white space and split words don't matter.
"""

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.arrays import bound

# Codes with their display names and the ways to write them; blanks may be missing around "&".
CODES = {
    "CCP": ("Code of Civil Procedure", "Code Civ. Proc."), "CIV": ("Civil", "Civ."), "VEH": ("Vehicle", "Veh."), "PEN": ("Penal", "Pen."), "EVID": ("Evidence", "Evid."),
    "GOV": ("Government", "Gov.", "Gov't"), "HSC": ("Health and Safety", "Health & Saf."), "BPC": ("Business and Professions", "Bus. & Prof."), "LAB": ("Labor", "Lab."),
    "PROB": ("Probate", "Prob."), "INS": ("Insurance", "Ins."), "FAM": ("Family", "Fam."), "WIC": ("Welfare and Institutions", "Welf. & Inst."), "EDC": ("Education", "Educ.", "Ed."),
    "CORP": ("Corporations", "Corp."), "COM": ("Commercial", "Com."), "PRC": ("Public Resources", "Pub. Res."), "PUC": ("Public Utilities", "Pub. Util."),
    "SHC": ("Streets and Highways", "Sts. & High."), "UIC": ("Unemployment Insurance", "Unemp. Ins."), "RTC": ("Revenue and Taxation", "Rev. & Tax."), "FGC": ("Fish and Game",),
    "FAC": ("Food and Agricultural", "Food and Agriculture"), "HNC": ("Harbors and Navigation",), "MVC": ("Military and Veterans",), "PCC": ("Public Contract", "Pub. Cont."),
    "WAT": ("Water", "Wat."), "ELEC": ("Elections", "Elec."), "FIN": ("Financial", "Fin."),
}

STATUTE = "struct<jurisdiction:string,code:string,section:string,subsection:string,display:string,raw:string,start:int,end:int>"
CASE = "struct<name:string,year:int,volume:int,reporter:string,page:int,pin:string,raw:string,start:int,end:int>"


# Reporters by their letters; a series such as 2d or 4th, and Supp., may follow.
REPORTERS = ("Cal.", "Cal.App.", "Cal.Rptr.", "U.S.", "F.", "F.Supp.", "N.Y.", "N.W.", "N.E.", "S.W.", "S.E.", "P.", "A.")
#: Words in lower case that a party's name may hold, and company forms that may follow a comma.
LINKS = {"of", "the", "and", "de", "la", "del", "von"}
FORMS = {"inc", "llc", "co", "corp", "ltd", "lp", "llp"}

_LETTERS = re.compile(r"[^a-z0-9&]+")
_WORDS = re.compile(r"[^\W_][\w'’.\-]*|&|\S")
_SIGN = re.compile(r"§§?|\bsections?\b", re.I)
_NUMBER = re.compile(r"\d+(?:\.\d+)?")
_SUB = re.compile(r"\s*\(([A-Za-z0-9]+)\)")
#: How far before a section sign a code's name may begin, and how many words it may have, split ones included.
_NAME_CHARS, _NAME_WORDS = 90, 8


@lru_cache(maxsize=1 << 14)
def _letters(name: str) -> str:
    return _LETTERS.sub("", name.lower())


_CODE_OF = {_letters(n) + "code": (code, names[0]) for code, names in CODES.items() for n in names}
#: Names that hold the word Code themselves, as in "Code of Civil Procedure section 203".
_WRITTEN_OUT = {_letters(n): (code, names[0]) for code, names in CODES.items() for n in names if "code" in n.lower()}
#: The longest name in letters, and the last letters of all: a sign with other ones before it cites no code.
_LONGEST = max(map(len, (*_CODE_OF, *_WRITTEN_OUT)))
_ENDS = tuple({n[-3:] for n in (*_CODE_OF, *_WRITTEN_OUT)})
_REPORTER_LETTERS = {_letters(r) for r in REPORTERS}


def read_sections(text: str, at: int, joined_by_and: bool = True) -> tuple[list[tuple[str, list[str]]], int]:
    """The section list that begins at a place: (number, its subsections) for each, and where the list ends."""
    out, end = [], at
    while number := _NUMBER.match(text, at):
        subs, end = [], number.end()
        while sub := _SUB.match(text, end):
            subs.append(sub[1])
            end = sub.end()
        out.append((number[0], subs))
        at = _blanks(text, end)
        comma = text.startswith(",", at)
        at = _blanks(text, at + comma)
        linked = joined_by_and and text[at : at + 3].lower() == "and" and text[at + 3 : at + 4].isspace()
        if not comma and not linked:
            break
        at = _blanks(text, at + 3) if linked else at
    return out, end


def _blanks(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def split_sections(blob: str) -> list[tuple[str, list[str]]]:
    """"1, 2, and 3(a)" as [("1", []), ("2", []), ("3", ["a"])]."""
    return read_sections(blob, _blanks(blob, 0))[0]


def _code_before(text: str, end: int, written_out: bool) -> tuple[tuple[str, str], int] | None:
    """The code whose name ends right before a place, and where the name begins; of several the longest."""
    if not _LETTERS.sub("", text[max(0, end - 12) : end].lower()).endswith(_ENDS):
        return None
    from_ = max(0, end - _NAME_CHARS)
    words = list(_WORDS.finditer(text[from_:end]))
    if words and words[-1][0] == ",":
        words.pop()
    joined, found = "", None
    for word in reversed(words[-_NAME_WORDS:]):
        if not _letters(word[0]):
            continue
        joined = _letters(word[0]) + joined
        if len(joined) > _LONGEST:
            break
        code = _CODE_OF.get(joined) or (_WRITTEN_OUT.get(joined) if written_out else None)
        if code:
            found = code, from_ + word.start()
    return found


def statutes_in(text: str | None, written_out: bool = True) -> list[dict]:
    """Each cited section, and each cited subsection besides, in order. `written_out` also finds codes whose name holds
    the word Code itself."""
    out, text = [], text or ""
    for sign in _SIGN.finditer(text):
        named = _code_before(text, sign.start(), written_out)
        sections, end = read_sections(text, _blanks(text, sign.end())) if named else ([], 0)
        for number, subs in sections:
            (code, name), start = named
            for sub in (None, *subs):
                display = f"{name} Code section {number}" + (f"({sub})" if sub else "")
                out.append({"jurisdiction": "CA", "code": code, "section": number, "subsection": sub, "display": display, "raw": text[start:end], "start": start, "end": end})
    return out


def _party_before(words: list[re.Match], at: int) -> int:
    """Where the party that ends before word `at` begins: at the first capital of its unbroken run of name words."""
    first, i = at, at
    while i:
        word = words[i - 1][0]
        if word == "," and i < at and _letters(words[i][0]) in FORMS:
            i -= 1
            continue
        if not (word[0].isupper() or word.rstrip(".") in LINKS):
            break
        i -= 1
        if word[0].isupper():
            first = i
    return first


def _party_after(words: list[re.Match], at: int) -> int:
    """Where the party that begins at word `at` ends."""
    if at >= len(words) or not words[at][0][0].isupper():
        return at
    i = at + 1
    while i < len(words):
        word = words[i][0]
        if word == "," and i + 1 < len(words) and _letters(words[i + 1][0]) in FORMS:
            i += 2
        elif word[0].isupper() or word.rstrip(".") in LINKS:
            i += 1
        else:
            break
    return i


_SERIES = re.compile(r"\d(?:d|st|nd|rd|th)")


def _reporter(words: list[re.Match], at: int) -> tuple[str, int] | None:
    """The reporter whose parts begin at word `at`, in its usual form, and the word after it."""
    parts, i = [], at
    while i < len(words) and (words[i][0][0].isupper() or _SERIES.fullmatch(words[i][0])):
        parts += [p for p in re.split(rf"(?<=\.)(?={_SERIES.pattern}|[A-Z])", words[i][0]) if p]
        i += 1
    name = "".join(p for p in parts if not _SERIES.fullmatch(p))
    known = _letters(name) in _REPORTER_LETTERS or _letters(name.removesuffix("Supp.")) in _REPORTER_LETTERS
    if not parts or not known or _SERIES.fullmatch(parts[0]):
        return None
    shown = parts[0]
    for before, part in zip(parts, parts[1:]):
        shown += (" " if _SERIES.fullmatch(before) else "") + part
    return shown, i


def _case_at(text: str, words: list[re.Match], v: int) -> dict | None:
    first, right = _party_before(words, v), _party_after(words, v + 1)
    if first == v or right == v + 1 or [w[0] for w in words[right : right + 3 : 2]] != ["(", ")"]:
        return None
    year, volume = words[right + 1][0], words[right + 3][0] if right + 3 < len(words) else ""
    found = _reporter(words, right + 4) if len(year) == 4 and year.isdecimal() and volume.isdecimal() else None
    if not found or found[1] >= len(words) or not (page := _NUMBER.match(words[found[1]][0])):
        return None
    last, pin = words[found[1]].start() + len(page[0].split(".")[0]), None
    after = re.compile(r",\s*(\d+(?:[-–]\d+)?)").match(text, last)
    if after:
        last, pin = after.end(), after[1]
    start = words[first].start()
    one = lambda a, b: " ".join(text[a:b].split())
    return {
        "name": f"{one(start, words[v].start())} v. {one(words[v + 1].start(), words[right - 1].end())}", "year": int(year), "volume": int(volume), "reporter": found[0],
        "page": int(page[0].split(".")[0]), "pin": pin, "raw": one(start, last), "start": start, "end": last,
    }


def cases_in(text: str | None) -> list[dict]:
    """Each "A v. B (year) volume reporter page[, pin]", in order."""
    if not text or "v." not in text:
        return []
    words = list(_WORDS.finditer(text))
    found = [_case_at(text, words, i) for i, w in enumerate(words) if w[0] == "v." and i]
    return [c for c in found if c]


def statute_citations(text: Column, written_out: bool = True) -> Column:
    """array of STATUTE. Rows that no citation can be in never reach Python."""

    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([statutes_in(t, written_out) for t in texts], dtype=object)

    return F.pandas_udf(find, f"array<{STATUTE}>")(F.when(text.rlike(r"(?i)(section|§)"), text))


def case_citations(text: Column) -> Column:
    """array of CASE."""

    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([cases_in(t) for t in texts], dtype=object)

    return F.pandas_udf(find, f"array<{CASE}>")(F.when(text.rlike(r"\sv\.\s"), text))


def section_items(blob: Column) -> Column:
    """The section numbers of a list, subsections included, without Python."""
    tokens = F.regexp_extract_all(blob, F.lit(r"([0-9.]+|\([^()]*\)|\s+|[^0-9.()\s]+|.)"), F.lit(1))
    nothing = F.struct(F.array().cast("array<string>").alias("items"), F.lit(False).alias("open"))

    def step(found: Column, token: Column) -> Column:
        """A number begins an item; brackets right behind one, blanks aside, belong to it; anything else ends it."""
        items, n = found["items"], F.size(found["items"])
        number, inner = F.btrim(token, F.lit(".")), F.btrim(token, F.lit("()"))
        bracket = F.startswith(token, F.lit("(")) & (inner != "") & ~F.regexp_like(inner, F.lit("[^A-Za-z0-9]"))
        joined = F.concat(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.coalesce(F.try_element_at(items, F.lit(-1)), F.lit("")), F.lit("("), inner, F.lit(")"))))
        return (
            F.when(F.startswith(F.ltrim(token, F.lit("0123456789")), F.lit(".")) & (number == ""), F.struct(items, F.lit(False).alias("open")))
            .when(F.translate(token, "0123456789.", "") == "", F.struct(F.concat(items, F.array(number)).alias("items"), F.lit(True).alias("open")))
            .when(bracket & found["open"], F.struct(joined.alias("items"), F.lit(True).alias("open")))
            .when(F.regexp_like(token, F.lit(r"\S")), F.struct(items, F.lit(False).alias("open")))
            .otherwise(found)
        )

    return F.aggregate(tokens, nothing, step, lambda found: found["items"])


def title_and_statute(full: Column) -> tuple[Column, Column]:
    """A title without the citation in parentheses at its end, and that citation (its text); null if there is none."""
    whole = F.trim(full)
    inside = F.rtrim(F.substring_index(whole, "(", -1), F.lit(")"))
    cited = whole.endswith(")") & F.contains(whole, F.lit("(")) & ~F.contains(inside, F.lit(")")) & F.contains(F.lower(inside), F.lit("code")) & inside.rlike(r"(?i)(section|§)\D{0,3}\d")
    before = F.left(whole, F.length(whole) - F.length(inside) - 2)
    return F.when(cited, F.rtrim(F.trim(before), F.lit(","))).otherwise(whole), F.when(cited, inside)


# What a history note may begin with.
ACTIONS = ("Enacted", "Amended", "Added", "Repealed", "Renumbered")


def behind(text: Column, *labels: str) -> Column:
    """What follows the first of the labels that a text holds; null if it holds none."""

    def after(t: Column) -> Column:
        found = F.lit(None).cast("string")
        for label in reversed(labels):
            at = F.instr(t, F.lit(label))
            found = F.when(at > 0, F.ltrim(F.substr(t, at + len(label)))).otherwise(found)
        return found

    return bound(text, after)


def first_word(text: Column) -> Column:
    """The first word without marks around it; null if there is none."""
    word = F.btrim(F.split_part(F.ltrim(text), F.lit(" "), F.lit(1)), F.lit(".,;:()"))
    return bound(word, lambda w: F.when(w != "", w))


def note_action(note: Column) -> Column:
    """The action that a note begins with; null if it begins with something else."""
    word = F.initcap(first_word(note))
    return F.when(word.isin(*ACTIONS), word)


_CAPITALS = "".join(map(chr, range(65, 91)))


def note_bill(note: Column) -> Column:
    """The bill number (capitals and a number) that stands in parentheses."""
    held = F.transform(F.slice(F.split(note, r"\("), 2, F.lit(1 << 30)), lambda x: F.when(F.contains(x, F.lit(")")), F.btrim(F.regexp_replace(F.split_part(x, F.lit(")"), F.lit(1)), r"\s+", " "))))

    def is_bill(x: Column) -> Column:
        number = F.ltrim(F.ltrim(x, F.lit(_CAPITALS)), F.lit(" "))
        end = F.ltrim(number, F.lit("0123456789"))
        return (F.ltrim(x, F.lit(_CAPITALS)) != x) & (end != number) & (F.ltrim(end, F.lit(_CAPITALS)) == "")

    return F.get(F.filter(held, is_bill), F.lit(0))


def history_note(raw: Column) -> Column:
    """struct of what a statute's history note says: action, statutes_year, chapter, section, bill_number and dates."""
    from corvane.functions.text import iso_date

    stats = F.split_part(behind(raw, "Stats."), F.lit(".  "), F.lit(1))
    year = first_word(stats)
    return F.struct(
        note_action(F.ltrim(raw, F.lit(" \n\t("))).alias("action"), F.when(year.rlike("^[0-9]{4}$"), year).cast("int").alias("statutes_year"), first_word(behind(stats, "Ch.")).alias("chapter"),
        first_word(behind(stats, "Sec.")).alias("section"), note_bill(raw).alias("bill_number"), iso_date(behind(raw, "Effective ")).alias("effective_date"), iso_date(behind(raw, "Operative ")).alias("operative_date"),
    )
