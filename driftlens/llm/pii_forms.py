"""Forms of personal information in free text: what may be an entity, and the terms around and inside it.

Runs inside Arrow batches. A form is either telling by itself (``seed``) or open: then the corpus decides.
"""

from __future__ import annotations

import re
from typing import NamedTuple

EMAIL, PHONE, ID, ADDRESS, PERSON = "email", "phone", "id_number", "address", "person"

_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
EMAIL_RE = re.compile(
    r"(?<![\w.+%@＠-])[\w][\w.+%'-]*"
    r"(?: ?[@＠﹫] ?| ?[\[({<] ?(?:at|AT|At|arroba|@) ?[\])}>] ?| (?:at|AT|arroba) (?=[\w-]+ (?:dot|DOT|punto|punkt|point) ))"
    rf"{_LABEL}(?: ?(?:\.|[\[({{<] ?(?:dot|DOT|punto|punkt|point|\.) ?[\])}}>]) ?{_LABEL}| (?:dot|DOT|punto|punkt|point) {_LABEL})*"
    r"(?: ?(?:\.|[\[({<] ?(?:dot|DOT|punto|punkt|point|\.) ?[\])}>]) ?| (?:dot|DOT|punto|punkt|point) )[A-Za-z]{2,24}(?![\w@＠])"
)

_NO, _END = r"(?<![\w.,:/#+(\-])", r"(?![\w/:]|[.,\-]\d|-[A-Za-z])"
#: (kind, form, telling by itself, pattern); the first that matches at a place wins. {b} is a group's own separator.
NUMBERS = [
    (PHONE, "plus-groups", True, r"\+\d{1,3}[ .\-]?\(\d{1,4}\)[ .\-]?\d{1,8}(?:[ .\-/]\d{1,8}){0,4}"),
    (PHONE, "plus", True, r"\+\d{1,3}(?:[ .\-/]\d{1,8}){1,6}|\+\d{8,15}"),
    (PHONE, "double-zero", True, r"00\d{1,3}(?:[ .\-/]\d{2,8}){2,6}|00\d{10,13}"),
    (PHONE, "bracket", True, r"\(\d{2,5}\)[ .\-]?\d{2,8}(?:[ .\-]\d{2,8}){0,3}"),
    (PHONE, "one-3-3-4", True, r"1[ .\-]\d{3}[ .\-]\d{3}[ .\-]\d{4}"),
    (PHONE, "3-3-4", True, r"\d{3}(?P<x>[ .\-])\d{3}(?P=x)\d{4}"),
    (PHONE, "zero-pairs", True, r"0\d(?:[ .\-]\d{2}){4}"),
    (ID, "3-2-4", True, r"\d{3}-\d{2}-\d{4}"),
    (ID, "3 2 4", False, r"\d{3}(?P<y>[ .])\d{2}(?P=y)\d{4}"),
    (ID, "2/3/", True, r"\d{2}/\d{3}/\d{4,7}"),
    (ID, "2 3 3 3", True, r"\d{2} \d{3} \d{3} \d{3}"),
    (ID, "2.3.3", False, r"\d{2}\.\d{3}\.\d{3}(?:-?[A-Za-z])?"),
    (ID, "8-letter", True, r"\d{7,8}[- ]?[A-Z]"),
    (ID, "letters", False, r"[A-Z]{2}\d{7}|[A-Z]\d{8}|[A-Z]{2}\d{2}[A-Z]{2}\d{5}"),
    (ID, "french", True, r"[12] \d{2} \d{2} \d{2} \d{3} \d{3}(?: \d{2})?"),
    (PHONE, "zero-groups", False, r"0\d{1,4}[ /.\-]\d{2,8}(?:[ .\-]\d{1,6}){0,3}"),
    ("number", "plain", False, r"\d{8,13}"),
]
NUMBER_RE = re.compile(_NO.replace("+(", "") + "(?:" + "|".join(f"(?P<n{i}>{p})" for i, (*_, p) in enumerate(NUMBERS)) + ")" + _END)
QUICK_NUMBER = re.compile(r"[\d(+][\d ().\-/]{6,}|[A-Z]\d{7}")

_CAP = r"[A-ZÀ-ÖØ-ÞŁŚŻ][\w'’]*"
_EN_TYPE = r"(?:Street|St\b\.?|Road|Rd\b\.?|Lane|Ln\b\.?|Avenue|Ave\b\.?|Drive|Dr\b\.?|Close|Crescent|Cres\b\.?|Terrace|Court|Ct\b\.?|Boulevard|Blvd\b\.?|Way|Place|Pl\b\.?|Square|Parkway|Gardens|Grove|Mews|Walk|Row|Hill|Alley|Highway)"
ADDRESS_RE = re.compile(
    "|".join(
        [
            rf"(?<![\w.,:/#-])\d{{1,5}}[a-zA-Z]?,? (?:{_CAP} ){{1,3}}{_EN_TYPE}(?!\w)",
            r"(?<![\w.,:/#-])\d{1,4}(?: ?(?:bis|ter|quater|[A-D]))?,? (?:rue|Rue|RUE|avenue|Avenue|AVENUE|av\.|Av\.|boulevard|Boulevard|bd\.?|Bd\.?|BD\.?|impasse|Impasse|IMPASSE|chemin|Chemin|CHEMIN|place|Place|PLACE|allée|Allée|quai|Quai|cours|route|Route|passage|sentier|ruelle) (?:d[eu]s?\b|de la|du|des|d'|de l'|[A-ZÀ-Ý])",
            r"(?<![\w-])(?:[A-ZÄÖÜ][\wäöüß]+[ -]){0,2}[A-ZÄÖÜ][\wäöüß]{1,}(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|damm|ufer|steig|chaussee|stieg|pfad|markt) \d{1,4}(?: ?[a-h])?(?!\w)",
            r"(?<![\w-])(?:[A-ZÄÖÜ][\wäöüß]+(?:er|sche|sches)?[ -])(?:Straße|Strasse|Str\.|Weg|Gasse|Platz|Allee|Ring|Damm|Ufer) \d{1,4}(?: ?[a-h])?(?!\w)",
            r"(?<![\w-])(?:Am|An der|An den|An dem|Im|In der|In den|Auf der|Auf dem|Zum|Zur|Unter den|Bei der|Beim|Hinter der|Vor dem|AM|AN DEN|AN DER|IM) (?:[A-ZÄÖÜa-zäöüß]+(?:en|EN) )?[A-ZÄÖÜ][\wäöüß]+ \d{1,4}(?: ?[a-h])?(?!\w|[.:]\d)",
            r"(?<![\w-])(?:C/|c/|Calle|calle|CALLE|Avda\.?|avda\.?|AVDA\.?|Avenida|avenida|Av\.|Paseo|paseo|PASEO|P\.º|Pza\.?|Plaza|plaza|PLAZA|Camino|camino|CAMINO|Carretera|Ctra\.?|Ronda|Travesía|Glorieta|Cuesta|Rambla) ?(?:de(?:l| las?| los)?|DE(?:L| LAS?| LOS)?)? ?[\wáéíóúñÁÉÍÓÚÑ'-]+(?: [A-ZÁÉÍÓÚÑ][\wáéíóúñ'-]+)?,? (?:n\.?º ?|núm\. ?)?\d{1,4}(?!\w|[.:]\d)",
            r"(?<!\w)(?:P\. ?O\. ?Box|PO Box|P\.O\.Box|p\.o\. box|P\.O\. BOX|PO BOX|Postfach|Apartado(?: de [Cc]orreos)?|BP|B\.P\.) \d{1,6}(?!\w)",
        ]
    )
)

#: Fixed list: titles that stand before a surname.
TITLES = "Dr Prof Mr Mrs Ms Miss Mme Mlle M Sr Sra Srta Don Doña Herr Frau Hr Fr Madame Monsieur Señor Señora Sir Lady Doctor Professor"
_TITLE = rf"(?:(?:{'|'.join(TITLES.split())}|{'|'.join(t.upper() for t in TITLES.split() if len(t) > 1)})\b\.?)"
_PART = r"(?:(?:de la|de las|de los|de|del|della|di|da|dos|van der|van den|van de|van|von der|von|zu|ter|ten|le|la|du|el|al|bin|ibn|y|DE LA|VAN DER|VAN|VON|DE|DEL) )"
_NAME = r"(?:[A-ZÀ-ÖØ-ÞĀ-Ž][^\W\d_]*(?:['’][^\W\d_]+)*(?:-[A-ZÀ-ÖØ-ÞĀ-Ž][^\W\d_]*)*)"
PERSON_RE = re.compile(
    rf"(?<![\w@.'’-])(?:(?P<title>{_TITLE}(?: {_TITLE})?) +(?P<titled>(?:{_NAME} (?:[A-Z]\. )?){{0,2}}{_PART}?{_NAME}))"
    rf"|(?<![\w@.'’-])(?P<initial>[A-ZÀ-Þ]\. ?(?:[A-ZÀ-Þ]\. ?)?{_PART}?{_NAME})"
    rf"|(?<![\w@.'’-])(?P<run>{_PART}?{_NAME}(?: (?:[A-Z]\. )?{_PART}?{_NAME}){{1,5}}|{_PART}?{_NAME}, {_NAME}(?! ?{_NAME}))"
)
WORD_RE = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
TOKEN_RE = re.compile(rf"{_NAME}")
DIGIT = re.compile(r"\d")
QUICK_AT = re.compile(r"(?:[\[({<] ?(?:at|AT|At|arroba)| (?:dot|DOT|punto|punkt|point)) ?[\])}>]?")
#: The same in Java's syntax: a text without any of these has no candidate, so it needn't reach Python at all.
JVM_FILTER = r"[0-9@＠﹫]|[\[({<] ?(?:at|AT|At|arroba)| (?:dot|DOT|punto|punkt|point) |\p{Lu}[^\s]*[.,]? +(?:\p{Lu}|(?:d[eiau]|del|dell?a|dos|v[ao]n|zu|ter|ten|l[ea]|[ae]l|bin|ibn|y) )|\p{Lu}\.\p{Lu}"
QUICK_NAME = re.compile(r"[A-ZÀ-ÖØ-ÞĀ-Ž][^\s]*[.,]? +(?:[A-ZÀ-ÖØ-ÞĀ-Ž]|(?:d[eiau]|del|dell?a|dos|v[ao]n|zu|ter|ten|l[ea]|[ae]l|bin|ibn|y) )|[A-Z]\.[A-Z]")


class Candidate(NamedTuple):
    kind: str  # the kind the form has, or 'number' where it may be a phone or an identity number
    form: str
    start: int
    end: int
    seed: bool
    left: list[str]  # up to three words before, nearest last
    right: str
    terms: list[str]  # words inside, for persons
    places: list[int]  # and where each starts
    above: list[str]  # up to two words that end what stands before the line, nearest last


def _around(text: str, start: int, end: int) -> tuple[list[str], str, list[str]]:
    """Words of the same line before and after, and the last ones of the line before. The words end at a full stop that closes a sentence."""
    before = text[max(0, start - 48) : start]
    cut = max(before.rfind("\n"), before.rfind("! "), before.rfind("? "), before.rfind("; "))
    words = WORD_RE.findall(before[cut + 1 :].lower())
    if cut < 0 and start > 48 and words:
        words = words[1:]
    after = WORD_RE.match(text[end : end + 24].lstrip(" ,.)>\"'»").lower())
    above = WORD_RE.findall(before[:cut].lower())[-2:] if cut > 0 else []
    return words[-3:], after.group() if after else "", above


def candidates(text: str) -> list[Candidate]:
    """All candidates of a text that don't overlap: emails, addresses and numbers first, then persons."""
    found: list[Candidate] = []
    taken: list[tuple[int, int]] = []

    def free(a: int, b: int) -> bool:
        return not any(x < b and a < y for x, y in taken)

    def add(kind: str, form: str, a: int, b: int, seed: bool, terms: list[str], places: list[int]) -> None:
        left, right, above = _around(text, a, b)
        found.append(Candidate(kind, form, a, b, seed, left, right, terms, places, above))
        taken.append((a, b))

    if "@" in text or "＠" in text or "﹫" in text or QUICK_AT.search(text):
        for m in EMAIL_RE.finditer(text):
            add(EMAIL, "email", m.start(), m.end(), True, [], [])
    if DIGIT.search(text):
        for m in ADDRESS_RE.finditer(text):
            if free(*m.span()):
                add(ADDRESS, "address", m.start(), m.end(), True, [], [])
        if QUICK_NUMBER.search(text):
            for m in NUMBER_RE.finditer(text):
                if not free(*m.span()):
                    continue
                name = next(k for k, v in m.groupdict().items() if v is not None and k[0] == "n")
                kind, form, seed, _ = NUMBERS[int(name[1:])]
                n = sum(c.isdigit() for c in m.group())
                if kind != PHONE or 8 <= n <= 15:
                    add(kind, f"plain{n}" if kind == "number" else form, m.start(), m.end(), seed, [], [])
    if QUICK_NAME.search(text):
        for m in PERSON_RE.finditer(text):
            kind = "titled" if m["titled"] else "initial" if m["initial"] else "run"
            a, b = m.span(kind)
            if not free(a, b):
                continue
            toks = [(t.group(), a + t.start()) for t in TOKEN_RE.finditer(text[a:b])]
            if kind == "run" and "," in m.group():
                kind = "comma"
            add(PERSON, kind, a, b, kind == "titled", [t.lower() for t, _ in toks], [p for _, p in toks])
    return found
