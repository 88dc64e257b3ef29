"""Forms of template residue, filler, error pages and script notices in a text. Runs inside Arrow batches.

``facts`` are told by their form. ``places`` are signs that may be residue or not, ``fillings`` what other records hold
in the same place: three words or marks on either side, in one segment, with numbers masked.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from operator import eq
from typing import NamedTuple

import numpy as np

from driftlens.llm.textnorm import fold, join_spaced

_ID = r"[A-Za-zÀ-ÿ_][\w.\-]*"
_ASK = r"(?i:insert|add|enter|your|fill in|put|type|replace|name of|placeholder|todo|tbd|inserte|inserta|insertar|su |tu |escriba|rellenar|ins[ée]rer|votre|saisir|à compl[ée]ter|a completer|einf[üu]gen|ihr |ihre |hier |name |platzhalter|link|date|company|customer|first|last|client|nombre|pr[ée]nom|nom )"
#: Fixed list: element names of HTML, whose tags are mark-up and no slot.
_HTML = "a abbr article aside b blockquote body br button caption center cite code col dd del details div dl dt em fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li main mark meta nav ol option p path pre q s samp script section select small source span strike strong style sub summary sup svg table tbody td textarea tfoot th thead time title tr tt u ul var video".split()
#: Words in square brackets that editors and transcripts use.
_EDITORIAL = "sic laughs laughter applause music inaudible crosstalk noise pause silence unintelligible edit edited citation emphasis redacted link_removed removed deleted i ii iii iv v x ref refs note"
#: A variable or a blank where a value should stand. Each alternative is a kind of syntax.
SLOT = re.compile(
    "|".join(
        [
            r"(?P<mustache>\{\{[^{}\n]*\}\}|\{\{\{[^{}\n]*\}\}\}|\{%[^%\n]*%\}|<%[^%\n]*%>|<\?=?[^?\n]*\?>)",
            rf"(?P<shell>\$\{{ ?{_ID} ?\}}|#\{{ ?{_ID} ?\}}|\$\$ ?{_ID} ?\$\$|\$\( ?{_ID} ?\)|%\( ?{_ID} ?\)s|%%{_ID}%%|%\{{ ?{_ID} ?\}})",
            rf"(?P<fence>(?<![\w%])%[A-Za-z_][\w.\-]+%(?![\w%])|(?<!\w)__[A-Za-z][\w.\-]*?__(?!\w)|@@{_ID}@@|##{_ID}##|\*\|{_ID}\|\*|\|\*{_ID}\*\||~~{_ID}~~|«{_ID}»(?=\s*[,.]))",
            rf"(?P<double>\[\[ ?{_ID}(?: [\w.\-]+){{0,3}} ?\]\]|<< ?{_ID}(?: [\w.\-]+){{0,3}} ?>>)",
            rf"(?P<square>\[(?!\s)(?:{_ASK}[^\[\]\n]*|{_ID}|[A-ZÀ-Þ][A-ZÀ-Þ _]{{2,}}|object Object|\.\.\.|…|_+|\?+)\](?!\())",
            rf"(?P<angle><(?:{_ASK}[^<>\n]*|{_ID})>|<!--[^<>\n]*(?:here|hier|aqu[ií]|ici|goes|todo|placeholder|insert)[^<>\n]*-->)",
            rf"(?P<curly>\{{(?:{_ID}|\d{{1,2}})\}})",
            r"(?P<paren>\((?:add|insert|enter|put|your|inserte|insertar|ins[ée]rer|ajouter|einf[üu]gen|hier|à compl[ée]ter)\b[^()\n]{2,40}\)|\((?:name|date|link|nombre|fecha|nom|datum)\))",
            r"(?P<blank>(?<!\w)X{2,}[/.\-]X{2,}(?:[/.\-]X{2,})?(?!\w)|(?<!\w)(?:DD|TT|JJ|MM)[/.\-](?:MM|DD)[/.\-](?:Y{4}|J{4}|A{4})(?!\w)|(?<![\w_])_{3,}(?![\w_])|(?<!\w)(?:TBD|TODO|FIXME)(?:_\w+)?(?!\w)|(?<!\w)(?P<same>undefined|null|NaN|None|nil)(?: \d{1,3}| (?P=same))(?!\w))",
            r"(?P<printf>(?<![\w%])%[sd](?!\w))",
        ]
    )
)
#: What some alternative of SLOT begins with or can't be without: a text without any of it has no slot. A test holds it against SLOT.
_SLOT_QUICK = re.compile(
    r"[{\[<%$#@|_«~*]|X{2}|(?:DD|TT|JJ|MM)[/.\-]|TBD|TODO|FIXME|undefined|null|NaN|None|nil|\((?:add|insert|enter|put|your|ins[ée]r|ajouter|einf[üu]gen|hier|à compl|name|date|link|nombre|fecha|nom|datum)"
)
_FENCED = re.compile(r"```.*?```|~~~.*?~~~|<(code|pre)\b[^>]*>.*?</\1>|`[^`\n]{1,200}`", re.S)
#: Lines of code outside a fence, and speech about syntax.
_CODE = re.compile(r"\b(?:print|printf|console\.log|echo|format)\s*\(|\b(?:const|let|var|def|return|import|function)\b .*[=({]|=\s*[`'\"]|=>|\w+\[['\"]\w+['\"]\]|\bf\"|</?\w+ [a-z-]+=|\{\s*\"")
_ABOUT = re.compile(
    r"\b(?:printf|syntax|interpolat\w+|placeholders?|variables?|format strings?|format specifiers?|shells?|regex\w*|escape\w*|escaping|templates? (?:engine|language|syntax)|brackets?|braces|tokens? (?:like|such)|stands? for|written as|macros?|parameters?|"
    r"platzhalter|syntaktisch|variablen?|marcador(?:es)?|sintaxis|espaces? r[ée]serv[ée]s?|syntaxe|the string|markdown|jinja|mustache|handlebars)\b",
    re.I,
)
#: A sign between these is shown, not used.
_OPENS = re.compile(r"[\"'“”„‘’‚«‹⟦「『]\s?$")
_CLOSES = re.compile(r"\s?[\"'“”‘’»›⟧」』]")
_SPLIT = re.compile(r"\n+|(?<=[.!?…])[\"')\]]*\s+| \| |(?<=[.!?])(?=[A-Z][a-z])")
_ROLE = re.compile(r"^(?:[>*#\-•\s]+|(?:user|assistant|system|nutzer|assistent|usuario|asistente|utilisateur|assistant\(e\)|bot|agent|human)\s*:\s*)+", re.I)
_HEAD = re.compile(r"^[^\d.!?|:]{3,40}(?: \d{1,6})?:?$")

#: Folded (lower case, no accents). Anchored: the message stands at the start of its segment.
ERROR = re.compile(
    r"^(?:http(?:/\d(?:\.\d)?)? ?)?(?:(?:error|fehler|erreur)[ :#]*)?(?:40\d|41\d|42\d|451|50\d|52\d)\b[ :.\-–—|]*(?:error|fehler|erreur)?[ :.\-–—|]*(?:$|page not found|not found|forbidden|unauthori[sz]ed|bad request|too many requests|method not allowed|gone|request timeout|"
    r"internal server error|service (?:temporarily )?unavailable|bad gateway|gateway time-?out|no encontrad[oa]|prohibido|error interno|servicio no disponible|nicht gefunden|verboten|interner serverfehler|dienst nicht verfugbar|introuvable|interdit|erreur interne|service indisponible|the page|la pagina|la page|die seite)"
    r"|^(?:error|fehler|erreur)[ :#]*(?:40\d|41\d|42\d|451|50\d|52\d)\b(?! (?:wurde|was|is|has|fue|a ete|est))"
    r"|^(?:page|seite|file|url|resource|pagina|archivo|fichier) (?:was |wurde |could |konnte )?(?:not|nicht|no|introuvable)\b.{0,12}(?:found|gefunden|be found|encontrad[oa]|existe|exist|available|verfugbar|disponible)?\s*(?:[.!(|:]|$)|^page introuvable|^pagina no encontrada"
    r"|^access (?:is |was )?denied(?:\s*[.!:|(]|$|,? you)|^zugriff verweigert|^acceso denegado|^acces refuse|^permission denied\s*(?:[.!:|]|$)|^forbidden\s*(?:[.!:|]|$)|^unauthorized\s*(?:[.!:|]|$)"
    r"|^you (?:don't|do not) have (?:permission|access)\b|^sie haben keine berechtigung|^no tiene(?:s)? permiso|^vous n'avez pas (?:la permission|l'autorisation|acces)"
    r"|^(?:an? |ein |un |une )?(?:internal|unexpected|unknown|interner|unerwarteter|unbekannter|error|erreur)(?: \w+)? (?:error|fehler|interno|interne|inesperado|inattendue)\b(?! budget| rate| code| handling)|^interner serverfehler|^error interno|^erreur interne|^internal server error"
    r"|^(?:oops|whoops|uh oh|hoppla|ups|oups)\b[ !,.:]*(?:$|.{0,60}(?:wrong|schief|mal|error|fehler|problem|found|gefunden|erreur|salio|passe))|^(?:something|etwas|algo|quelque chose) (?:went wrong|ist schiefgelaufen|ist schief gelaufen|salio mal|s'est mal passe|a mal tourne)"
    r"|^an error (?:has )?occurred|^es ist ein (?:\w+ )?fehler aufgetreten|^ein (?:\w+ )?fehler ist aufgetreten|^(?:se )?ha(?:n)? ocurrido un error|^se produjo un error|^une erreur (?:interne )?(?:s'est produite|est survenue)"
    r"|^(?:your |ihre |su |votre )?(?:session|sitzung|sesion) (?:has |ist |ha )?(?:expired|timed out|abgelaufen|expirado|caducado|a expire)|^votre session a expire|^la session a expire"
    r"|^fatal error|^database error|^uncaught (?:exception|error|typeerror)|^traceback \(most recent|^unhandled exception|^stack trace|^connection (?:refused|timed out|reset)\s*(?:[.!:|]|$)|^could not connect to (?:the )?(?:server|database)|^error establishing a database"
    r"|^too many requests|^rate limit exceeded|^bad gateway|^gateway time-?out|^service (?:temporarily |currently |momentanement |temporairement )?(?:unavailable|indisponible)|^servicio (?:temporalmente |momentaneamente )?no disponible|^(?:dienst|service|seite) (?:vorubergehend |derzeit |zurzeit )?nicht (?:verfugbar|erreichbar)"
    r"|^(?:the|this|die|diese|la|esta|cette) (?:page|site|url|seite|pagina) (?:you (?:requested|asked for|are looking for|were looking for)|could not be|cannot be|can't be|is not available|isn't available|konnte nicht|existiert nicht|no existe|no se encuentra|no esta disponible|n'existe pas|est introuvable|que (?:busca|ha solicitado|vous))"
    r"|^we (?:can't|cannot|couldn't|could not) find (?:the|that) page|^under maintenance|^(?:the )?(?:site|page) is (?:down|under) (?:for )?(?:maintenance|construction)|^captcha\b|^please complete the captcha"
)
NOTICE = re.compile(
    r"\b(?:enable|turn on|switch on|activate|allow|accept|unblock)\b[^.]{0,25}\b(?:javascript|java script|scripts|scripting|cookies)\b|\b(?:javascript|java script|scripts|scripting|cookies)(?: and (?:javascript|scripts|cookies))? (?:is|are|must be|has to be|have to be|need to be|needs to be)\b[^.]{0,20}\b(?:required|enabled|disabled|needed|turned on|switched on|turned off|switched off|blocked|off|activated|allowed)\b"
    r"|\b(?:requires?|needs?)\b[^.]{0,15}\b(?:javascript|java script|scripts|cookies)\b|\b(?:does not|doesn't|do not) (?:support|allow|accept|have)\b[^.]{0,15}\b(?:javascript|scripts|cookies)\b|\byour browser (?:blocks|is blocking|has blocked)\b|\b(?:without|disabled) javascript\b[^.]{0,30}\b(?:work|not|load)"
    r"|\bchecking your browser\b|\bverify (?:that )?you(?:'re| are) (?:a )?human\b|\bcookies? (?:und|and|y|et) (?:skripte|scripts|javascript) (?:must|mussen|deben|doivent)"
    r"|\b(?:javascript|skripte|scripts|cookies)\b[^.]{0,40}\b(?:aktivieren|aktiviert werden|eingeschaltet|einschalten|zulassen|erlauben|erforderlich|benotigt|deaktiviert|ausgeschaltet|blockiert)\b|\b(?:aktivieren sie|schalten sie|erlauben sie)\b[^.]{0,25}\b(?:javascript|skripte|scripts|cookies)\b|\b(?:benotigt|braucht|erfordert)\b[^.]{0,15}\b(?:javascript|skripte|scripts|cookies)\b|\bihr browser (?:blockiert|unterstutzt)\b"
    r"|\b(?:activ[ae]|habilit[ae]|permit[ae]|acept[ae]|active|habilite)\b[^.]{0,25}\b(?:javascript|scripts|cookies)\b|\b(?:necesita|requiere|precisa)\b[^.]{0,15}\b(?:javascript|scripts|cookies)\b|\b(?:javascript|scripts|cookies)\b[^.]{0,25}\b(?:desactivad[oa]s?|deshabilitad[oa]s?|obligatori[oa]s?|necesari[oa]s?)\b|\bsu navegador (?:no admite|no soporta|bloquea)\b"
    r"|\b(?:activer|activez|autoriser|autorisez|accepter|acceptez)\b[^.]{0,25}\b(?:javascript|scripts|cookies)\b|\b(?:necessite|exige|requiert)\b[^.]{0,15}\b(?:javascript|scripts|cookies)\b|\bbloque(?:nt)? (?:les )?(?:javascript|scripts|cookies)\b|\b(?:javascript|scripts|cookies)\b[^.]{0,25}\b(?:desactives?|obligatoires?|necessaires?|requis)\b|\bvotre navigateur (?:ne supporte|ne prend|bloque)\b"
)
FILLER = re.compile(
    r"^(?:your|the|sample|dummy|demo|example|default|placeholder|filler|body|some) (?:text|copy|content|paragraph|headline|title|description)(?: (?:goes|comes|here|will|for|only|paragraph)\b.{0,40}|,? do not publish| ?[.!:]*)$|^(?:placeholder|filler|dummy) (?:paragraph|text|copy)\b.{0,30}$|\b(?:your|add your|insert your|enter your) (?:text|content|copy|title|headline) (?:goes )?here\b"
    r"|^click here to edit\b|^double[- ]click to edit\b|^this is (?:a |some )?(?:sample|dummy|placeholder|filler) (?:text|paragraph|copy|content)\b|^content coming soon|^coming soon[.!]*$|^(?:text|inhalt|beschreibung) folgt(?: in kurze)?\.*$|^hier (?:steht|entsteht|folgt|kommt) (?:bald |in kurze |spater )?(?:ihr|dein|der|ein) (?:inhalt|text)\b|^(?:blindtext|platzhaltertext|mustertext|beispieltext)\b.{0,30}$"
    r"|^texte? de (?:remplissage|relleno|prueba|ejemplo|exemple|substitution)\b.{0,20}$|^texto de (?:relleno|prueba|ejemplo|muestra)\b.{0,20}$|^(?:contenido|contenu) (?:proximamente|a venir|en preparation|en preparacion)\b.{0,20}$|^(?:su|tu|votre|ton) texte?o? (?:aqui|ici)\b|^votre texte ici|^(?:dummy|sample) (?:copy|text),? do not publish"
)
#: Fixed list: the words of the usual Latin filler, without those that living languages share.
LOREM = frozenset(
    "lorem ipsum dolor amet consectetur adipiscing adipisicing elit eiusmod tempor incididunt labore dolore aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit cillum fugiat pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum magna".split()
)
_TOKEN = re.compile(r"[^\W_]+")
#: A folded text without any of these matches none of ERROR, or none of FILLER; most texts end here.
_ERRORS = tuple(
    "error erreur fehler verweigert denegado denied refuse forbidden unauthori introuvable encontrad encuentra gefunden found permis berechtigung autoris acces wrong schief salio tourne oops whoops "
    "hoppla ups oups expir abgelaufen caducad fatal exception traceback reset gateway available disponible verfugbar erreichbar exceeded requests maintenance construction captcha can't cannot could konnte exist "
    "reached page seite file url resource pagina archivo fichier site intern inesperad inattendue"
    .split()
) + ("uh oh", "timed out", "stack trace", "mal passe")
_CODES = re.compile(r"\b(?:40|41|42|45|50|52)\d\b")
_FILLERS = tuple("text copy content inhalt beschreibung folgt click soon paragraph headline title contenu contenido platzhalter description".split())
_SCRIPTS = ("script", "cookie", "browser", "navegador", "navigateur", "human", "skripte")
_APART = re.compile(r"r[ .\-_*·]i[ .\-_*·]p[ .\-_*·]t|k[ .\-_*·]i[ .\-_*·]e")


class Fact(NamedTuple):
    kind: str  # slot, error, notice, filler; open and name: the corpus decides
    template: str  # the segment with the slot, numbers and ids masked
    value: str  # what stands in the slot
    beside: str  # the segments around, as a sign of where the template is used
    place: int = 0  # of open and name: a hash of the words around


def segments(text: str) -> list[str]:
    """Sentences, lines and cells, without speaker names, quote marks and bullets."""
    return [s for s in (_ROLE.sub("", p).strip() for p in _SPLIT.split(text)) if s]


def masked(segment: str) -> str:
    return re.sub(r"\b(?=\w*\d)[0-9a-f]{6,}\b|\d+", "0", segment)


def _repeats(words: list[str]) -> bool:
    """Whether a phrase of up to four words is said over and over."""
    n = len(words)
    for period in range(1, 5):
        if sum(map(eq, words[period:], words)) < 5:
            continue
        run = 0
        for i in range(period, n):
            run = run + 1 if words[i] == words[i - period] else 0
            if run >= max(5 if period == 1 else 3 * period, 5):
                return True
    return False


def facts(text: str) -> list[Fact]:
    """What a text holds that may be residue; the corpus has the last word on slots."""
    out: list[Fact] = []
    plain = _FENCED.sub(" ", text) if "`" in text or "~~~" in text or "<code" in text or "<pre" in text else text
    low_all = fold(plain)
    quick = _SLOT_QUICK.search(plain)
    apart = _APART.search(low_all)
    scripts = apart or any(w in low_all for w in _SCRIPTS)
    errors = any(w in low_all for w in _ERRORS) or _CODES.search(low_all)
    fillers = any(w in low_all for w in _FILLERS)
    parts = segments(plain) if quick or scripts or errors or fillers else []
    for k, s in enumerate(parts):
        near = (parts[k - 1] if k else "") + "|" + (parts[k + 1] if k + 1 < len(parts) else "")
        low = fold(s) if errors or fillers or scripts else ""
        if errors and ERROR.search(low):
            out.append(Fact("error", masked(low), "", near))
        if scripts and NOTICE.search(join_spaced(low) if apart else low):
            out.append(Fact("notice", masked(low), "", near))
        if fillers and FILLER.search(low):
            out.append(Fact("filler", masked(low), "", near))
        if quick:
            found = [m for m in SLOT.finditer(s) if _is_slot(m)]
            if found and not _CODE.search(s):
                for m in found:
                    if _ABOUT.search(s[max(0, m.start() - 70) : m.start()]) or _ABOUT.search(s[m.end() : m.end() + 40]):
                        continue
                    a, b = s[: m.start()], s[m.end() :]
                    shape = " ".join([*a.split()[-3:], "*", *b.split()[:3]])
                    if not (_OPENS.search(a) and _CLOSES.match(b)):
                        out.append(Fact("slot", masked(shape), m.group(), near))
    words = _TOKEN.findall(low_all)
    lorem = sum(w in LOREM for w in words) if len(LOREM.intersection(words)) >= 5 else 0
    if lorem >= 8 and _dense(words) or _repeats(words):
        out.append(Fact("filler", "lorem" if lorem >= 8 else "repeats", "", ""))
    return out


#: A default, a blank that has left a trace, or a variable's name without any syntax.
OPEN = re.compile(r"(?<![\w/$@.\-])(?:(?P<default>N/A|n/a|NULL|null|NaN|None|nil|undefined)|(?P<name>[A-Za-z]+(?:_[A-Za-z]+)+|[a-z]+[A-Z][A-Za-z]+))(?![\w/@(=\-])|(?P<blank>\( *\)|“ *”|« *»|(?<=\w) +(?=[,;]\s))")
_PARTS = re.compile(r"\w+(?:['’]\w+)*|[^\w\s]")
_SIDE, _LONGEST = 3, 3
_MASK, _LEFT, _RIGHT = (1 << 64) - 1, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


@lru_cache(200_000)
def _code(part: str) -> int:
    """A number of a word or mark, 0 for nothing."""
    return zlib.crc32(re.sub(r"\d+", "0", part.lower()).encode()) + 1 if part else 0


def _place(left: list[str], right: list[str]) -> int:
    """The place between the words; 0 where too few are there to know it again."""
    if len(left) + len(right) < 2 or not any(p[0].isalpha() for p in left + right):
        return 0
    a = ([0] * _SIDE + [_code(p) for p in left])[-_SIDE:]
    b = ([_code(p) for p in right] + [0] * _SIDE)[:_SIDE]
    got = sum(x * y for x, y in zip(a + b, _LEFT + _RIGHT, strict=True)) & _MASK
    return got - (1 << 64) if got >> 63 else got


def places(text: str) -> list[Fact]:
    """Signs that residue may have left, in places that the corpus has to know: shown or spoken of, defaults, blanks, names."""
    out: list[Fact] = []
    plain = _FENCED.sub(" ", text) if "`" in text or "~~~" in text or "<code" in text or "<pre" in text else text
    quick = _SLOT_QUICK.search(plain)
    if not quick and not OPEN.search(plain):
        return out
    parts = segments(plain)
    for k, s in enumerate(parts):
        slots = [m for m in SLOT.finditer(s) if _is_slot(m)] if quick else []
        taken = [m.span() for m in slots]
        open_ = [m for m in OPEN.finditer(s) if not any(a < m.end() and m.start() < b or a == m.end() or b == m.start() for a, b in taken)]
        if not slots and not open_ or _CODE.search(s):
            continue
        near = "|".join(parts[max(0, k - 1) : k + 2])
        for m in slots + open_:
            a, b = s[: m.start()], s[m.end() :]
            spoken = _ABOUT.search(a[-70:]) or _ABOUT.search(b[:40])
            if m.re is SLOT and not (spoken or _OPENS.search(a) and _CLOSES.match(b)) or m.re is OPEN and spoken:
                continue
            place = _place(_PARTS.findall(a)[-_SIDE:], _PARTS.findall(b)[:_SIDE])
            if place:
                out.append(Fact("name" if m.re is OPEN and m["name"] else "open", "", m.group(), near, place))
    return out


def fillings(text: str, wanted: np.ndarray) -> list[tuple[int, int, int]]:
    """``(place, value, segment)``: what stands in the places that the bits of ``wanted`` allow; up to three words, as hashes."""
    plain = _FENCED.sub(" ", text) if "`" in text or "~~~" in text or "<code" in text or "<pre" in text else text
    parts = segments(plain)
    words, of = [""] * _SIDE, [-1] * _SIDE
    for k, s in enumerate(parts):
        found = _PARTS.findall(s)
        words += found + [""] * _SIDE
        of += [k] * len(found) + [-1] * _SIDE
    n = len(words)
    code = np.array([_code(w) for w in words], dtype=np.uint64)
    inside = np.array(of) >= 0
    left, right = np.zeros(n + 1, dtype=np.uint64), np.zeros(n + 1, dtype=np.uint64)
    for i in range(_SIDE):
        left[_SIDE : n + 1] += code[i : n + 1 - _SIDE + i] * np.uint64(_LEFT[i])
        right[: n + 1 - _SIDE] += code[i : n + 1 - _SIDE + i] * np.uint64(_RIGHT[i])
    out, able = [], inside
    for size in range(1, _LONGEST + 1):
        able = inside if size == 1 else able[:-1] & inside[size - 1 :]
        at = np.flatnonzero(able)
        place = left[at] + right[at + size]
        hit = (wanted[(place >> np.uint64(6)) & np.uint64(len(wanted) - 1)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        for i, p in zip(at[hit].tolist(), place[hit].astype(np.int64).tolist(), strict=True):
            value, k = " ".join(words[i : i + size]), of[i]
            if any(w[0].isalnum() for w in words[i : i + size]) and not OPEN.fullmatch(value) and not SLOT.search(value) and "_" not in value:
                out.append((p, zlib.crc32(value.lower().encode()), zlib.crc32("|".join(parts[max(0, k - 1) : k + 2]).encode())))
    return out


def _dense(words: list[str], window: int = 10, least: int = 7) -> bool:
    hits = [w in LOREM for w in words]
    have = sum(hits[:window])
    for i in range(len(hits) - window + 1):
        if have >= least:
            return True
        if i + window < len(hits):
            have += hits[i + window] - hits[i]
    return have >= least


def _is_slot(m: re.Match[str]) -> bool:
    value = m.group()
    if m["square"]:
        inner = value[1:-1]
        return not (inner.isdigit() or len(inner) < 2 and inner not in "?_" or inner.lower() in _EDITORIAL.split())
    if m["angle"]:
        inner = value[1:-1].strip("/ ")
        return inner.lower() not in _HTML
    return True
