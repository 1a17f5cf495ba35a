"""Template residue, filler, error pages and script notices in place of content.

Numbers, dates, addresses and identifiers of all sentences are masked;
equal masked messages are grouped across documents and sources by hash; every
distinct message is then classified once, by rules on
placeholders and phrases; and the classes decide on the documents.

A document is residue if one of its messages has an unfilled placeholder or empty
value where words belong, or if it has residue messages and, apart from site
furniture, nothing else.

Messages that no rule knows are judged by how they recur. A message is *wide* if it
stands in at least ``RECURS`` documents and sources; a text is *closed* if it has no
row of data and no message that is neither known nor wide. Sentences of articles
recur beside sentences that don't; messages of a site stand alone. So a wide message
is residue too, without any rule on its words, if it stands in ``WIDE`` different
texts of which a share of ``PURE`` is closed, or as good as only beside residue;
and one that keeps to the first and last lines of its texts is furniture.
"""

from __future__ import annotations

import html
import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.session import durable, spread

#: Documents and sources in which a message recurs; different texts from which on recurrence alone decides; shares of closed texts, of documents with other residue, and of edges.
RECURS, WIDE, PURE, BESIDE, EDGE = 3, 8, 0.7, 0.9, 0.95
#: A message in more than one of this many rows is joined from a broadcast of at most as many messages, all others by a shuffle.
HOT = 2_000

# --- Segments -----------------------------------------------------------------

TITLE = re.compile(r"<title\b[^>]*>.*?</title>|<(script|style)\b[^>]*>.*?</\1>|<!--.*?-->", re.I | re.S)
PAGE_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title>", re.I | re.S)
INLINE = re.compile(r"</?(?:a|abbr|b|big|code|del|em|font|i|ins|mark|q|s|small|span|strong|sub|sup|tt|u|wbr)(?:\s[^<>]*)?/?>", re.I)
#: HTML tags in lower or upper case; <TICKER> and <insert city> are none.
BLOCK = re.compile(
    r"</?(?:!doctype|html|head|body|meta|link|noscript|div|p|br|hr|h[1-6]|ul|ol|li|dl|dt|dd|table|thead|tbody|tr|td|th|section|article|header|footer|nav|main|aside|figure|figcaption|blockquote|pre|img|form|input|button|label)(?:\s[^<>]*)?/?>",
    re.I,
)
LINES = re.compile("[\r\n\u2028\u2029\x0b\x0c\x85]+")
SENTENCES = re.compile(r"(?<=[.!?…])[\"'”’»)]*\s+")
ADDRESS = re.compile(r"https?://\S+|www\.\S+|[\w.+-]+@[\w-]+\.[\w.-]+", re.I)
#: Numbers, and identifiers of at least seven hexadecimal digits or after req-.
NUMBER = re.compile(r"\b(?:req-)?[0-9a-fA-F]{7,}\b|\breq-\d+\b|\d+(?:[.,:]\d+)*")
#: Without one of these a number is digits and nothing else.
LONG = re.compile(r"[0-9a-fA-F]{7}|req-")
DIGITS = re.compile(r"\d+(?:[.,:]\d+)*")
DIGIT = re.compile(r"\d")
WORD = re.compile(r"[^\W\d_]+")
#: Months and weekdays in English, Spanish and French; those that are other words too only with a capital.
MONTHS = """january february march april june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec
    enero febrero marzo abril mayo junio julio agosto septiembre setiembre octubre noviembre diciembre ene abr ago dic
    janvier février fevrier mars avril mai juin juillet août aout septembre octobre novembre décembre decembre janv févr fevr avr juil déc""".split()
DAYS = """monday tuesday wednesday thursday friday saturday sunday lunes martes miércoles miercoles jueves viernes sábado sabado domingo
    lundi mardi mercredi jeudi vendredi samedi dimanche tue tues thu thur thurs fri""".split()
CAPITAL = frozenset(["may", "mon", "wed", "sat", "sun"])
DATE_NAMES = frozenset([*MONTHS, *DAYS, *CAPITAL])
#: The names as a sentence's words show them, with the mark that follows.
DATE_WORDS = frozenset(name + mark for name in DATE_NAMES for mark in ("", ",", "."))
BEFORE = re.compile(r"(?<![^\W\d_])([^\W\d_]{3,10})(\.?,?[ /-](?:(?:de|of|del|the|el|le) )?)0(?:st|nd|rd|th|er|º)?(?!\w)", re.I)
AFTER = re.compile(r"\b0(?:st|nd|rd|th|er|º|o)?,?[ /-](?:(?:de|of|del) )?([^\W\d_]{3,10})(?![^\W\d_])\.?", re.I)
SEVERAL = re.compile(r"\b0(?:st|nd|rd|th|er|º|o)?(?:(?:,? (?:(?:de|of|del) )?|[/-])0\b)+", re.I)
COMBINING = re.compile("[\u0300-\u036f\u0483-\u0489\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]")
INVISIBLE = re.compile(r"[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")


def _number(m: re.Match[str]) -> str:
    return "0" if DIGIT.search(m[0]) else m[0]


def _dated(m: re.Match[str]) -> str:
    name = m[1]
    low = name.lower()
    return "0" if low in DATE_NAMES and not (low in CAPITAL and name[0].islower()) else m[0]


def mask(sentence: str) -> str:
    """Numbers, identifiers, addresses and dates, with names of months and weekdays beside a number, as 0 and one word; case and marks stay."""
    s = sentence
    if "@" in s or "://" in s or "www." in s.lower():
        s = ADDRESS.sub("address", s)
    if DIGIT.search(s):
        s = " ".join((NUMBER.sub(_number, s) if LONG.search(s) else DIGITS.sub("0", s)).split())
        if not DATE_WORDS.isdisjoint(s.lower().replace("-", " ").replace("/", " ").split()):
            s = SEVERAL.sub("0", AFTER.sub(_dated, BEFORE.sub(_dated, s)))
    return " ".join(s.split())


def fold(s: str) -> str:
    """Lower case without accents and outer punctuation, straight quotes."""
    s = s.replace("’", "'").replace("‘", "'").replace("“", '"').replace("”", '"')
    if not s.isascii():
        s = COMBINING.sub("", unicodedata.normalize("NFKD", s))
    return s.casefold().strip(" \t.!?…*_~-:;>")


#: A unit of words over and over, and what programs put before and around an error's text.
AGAIN = re.compile(r"(.{2,80}?)(?:[ ,.;:!?]+\1)+")
RAISED = re.compile(r"\b\w+(?:error|exception)\b")
FILE = re.compile(r"[\w/\\.-]+\.(?:py|js|java|php|rb|go|html?|aspx?)\b")


def _repeats(s: str) -> bool:
    """Whether most of a text's words are repetitions, so that it may be one unit over and over."""
    ws = s.split()
    return len(ws) > 2 and 2 * len(set(ws)) <= len(ws) + 1


def key(message: str) -> str:
    """The form in which messages are compared across documents and sources: folded, one unit for its repetitions, names of errors and files as one word."""
    s = fold(message)
    if _repeats(s) and (unit := AGAIN.fullmatch(s)):
        s = unit[1]
    if "error" in s or "exception" in s:
        s = RAISED.sub("error", s)
    return FILE.sub("file", s) if "." in s else s


def is_data(line: str) -> bool:
    """Whether a line is a row of a data snippet: tab- or comma-separated, or JSON that is no error message."""
    if line.count("\t") >= 2:
        return True
    s = line.strip().rstrip(",")
    if re.search(r'"[\w .-]+"\s*:', s) and not re.search(r'"(?:error|errors)"\s*:', s):
        return True
    if s[:1] in "[{" and s[-1:] in "]}":
        try:
            return isinstance(json.loads(s), list)
        except ValueError:
            return False
    cells = re.split(r"[;,|]", s)
    return len(cells) >= 4 and all(len(c.split()) <= 2 for c in cells) and sum(bool(re.search(r"\d", c)) for c in cells) * 2 >= len(cells) and not re.search(r"[{%$#@<\[]", s)


def segments(text: str) -> Iterator[tuple[str, bool, bool]]:
    """(sentence, is data, is in the first or last of several lines or sentences) of a text; markup is resolved, a page's title counts only if it has a placeholder."""
    if "<" in text:
        for m in PAGE_TITLE.finditer(text):
            if _placeholder(title := " ".join(html.unescape(m[1]).split())):
                yield title, False, False
        text = TITLE.sub("\n", text)
        text = BLOCK.sub("\n", INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    text = INVISIBLE.sub("", text.replace("\xa0", " "))
    lines = [line for line in map(str.strip, LINES.split(text)) if line]
    for k, line in enumerate(lines):
        edge = k == 0 or k == len(lines) - 1
        if is_data(line):
            yield line, True, False
        elif line[0] == "{" and line[-1] == "}" and re.search(r'"errors?"\s*:', line):
            yield line, False, edge
        else:
            said = [s for s in map(str.strip, SENTENCES.split(line)) if s]
            for i, s in enumerate(said):
                yield s, False, edge and (len(lines) > 1 or i in (0, len(said) - 1))


# --- Rules --------------------------------------------------------------------

NAME = r"[A-Za-z][\w.]*(?: [\w.]+){0,3}"
#: What may stand between doubled or mixed delimiters: a name, a path, a filter or a helper call.
INSIDE = r"[#/^&>!=-]?\s*[A-Za-z][\w .:|'\"()\[\]-]{0,60}?"
#: A name as programs write it: with underscores, or in camel case.
CODED = r"[A-Za-z]+(?:_[A-Za-z0-9]+)+|[a-z]+(?:[A-Z][a-z]+)+"
_PAIRS = [(r"\{\{", r"\}\}"), (r"\{%", r"%\}"), (r"<%[=-]?", r"%>"), (r"\[%", r"%\]"), (r"\[\[", r"\]\]"), (r"<<", r">>"), (r"\(\(", r"\)\)"), (r"\*\|", r"\|\*")]
_PAIRS += [(rf"{mark}\{{", r"\}") for mark in (r"\$", "#", "@", "%", r"\*")] + [(r"\$\(", r"\)"), (r"\$\[", r"\]")]
_DOUBLED = [r"@@", "%%", "##", r"\$\$", "~~", r"\|\|", "::", "!!", r"\^\^", r"\+\+"]
_SINGLE = ["#", "%", r"\$", "@", "~", r"\^"]
#: Unfilled placeholders by their delimiters (forms of common template languages and editors' notes).
PLACEHOLDER = re.compile(
    "|".join(
        (
            *(rf"{opening}\s*{INSIDE}\s*{closing}" for opening, closing in _PAIRS),
            *(rf"{mark}\s*{NAME}\s*{mark}" for mark in _DOUBLED),
            *(rf"(?<![\w{mark}]){mark}[A-Z][A-Z_.]{{2,}}{mark}(?!\w)" for mark in _SINGLE),
            r"%\([A-Za-z][\w.]*\)[sdf]",
            r"(?<![\w%])%(?:\d\$)?(?:\.\d)?[sdf](?!\w)",
            r"__[A-Za-z][A-Za-z0-9]*(?:[_.][A-Za-z0-9]+)*__",
            r"(?<![\w{$\\])\{(?:\d{1,2}|[A-Za-z][\w.]*)\}(?!\})",
            r"<(?!(?:HTML|HEAD|BODY|DIV|SPAN|TABLE|TITLE|PRE|CODE|IMG)>)[A-Z][A-Z_. ]{2,}>",
            rf"[<(|](?:{CODED})[>)|]",
            rf"(?<![\w$])\$(?:{CODED})\b",
            r"\b[A-Z]+(?:_[A-Z]+)+\b",
            rf"(?i:[<(](?:insert|your|enter|add) {NAME}[>)])",
            rf"(?i:\[(?:insert|your|enter|add|add your) {NAME}\])",
            rf"(?i:\[{NAME} here\])",
            rf"(?i:\[(?:su|tu|inserte|insertar) {NAME} aqu[ií]\])",
            rf"(?i:\[(?:inserte|insertar|poner|completar) {NAME}\])",
            rf"(?i:\[(?:à|a) (?:compléter|completer|remplir|préciser)(?: ?: ?{NAME})?\])",
            rf"(?i:\[(?:votre|insérer|inserer) {NAME}(?: ici)?\])",
            rf"\[(?:{CODED}|(?!SIC\])[A-Z][A-Z_. ]{{2,}}|[A-Z][a-z]+(?:[ _][A-Z][a-z]+)+)\]",
            r"«\s?[A-Z][A-Z_.]{2,}\s?»",
            r"(?i:[\[(<](?:tbd|tbc|tba|tk|xx+|blank|empty|missing|n/a|no value)[\])>])",
            r"\[\s?[●•*_]\s?\]|(?<!_)_{3,}(?!\w)",
            r"\bX{1,3}(?:[.,]X{1,3})+\b|[$€£]X{1,3}\b|\bX{2,3} ?(?:%|(?:million|billion|millones|millions|percent|per cent)\b)",
            r"\b(?:DD|MM|JJ)[/.-](?:MM|DD)[/.-](?:YYYY|AAAA|YY|AA)\b|\bYYYY-MM-DD\b",
        )
    )
)
#: Values that a program left for a missing one.
EMPTY = re.compile(r"#(?:REF!|N/A\b|VALUE!|DIV/0!|NAME\?|NUM!|NULL!|ERROR!)|#{4,}|\[object Object\]|\bInvalid Date\b|<NA>|(?<![\w\"'-])(?:undefined|null|NaN|NaT|None|nil|N/A)(?![\w\"'-])", re.I)
#: Before or after such a mark: it is spoken of, not left over.
SPOKEN_BEFORE = re.compile(
    r"(?:\b(?:tokens?|placeholders?|markers?|variables?|tags?|literals?|literally|marked|written|reading|typed|syntax|merge fields?|spelled|says?|saying|entered|shown|labell?ed)"
    r"|\b(?:marcador(?:es)?|etiquetas?|variables?|marcad[oa]s?|escrit[oa]s?|balises?|marqueurs?|marque(?:e|é)?s?|marqué(?:e)?s?|jetons?))(?: as| como| comme)?\s*[\"'“«`(]*\s*$",
    re.I,
)
SPOKEN_AFTER = re.compile(r"^[\"'”»`)]*\s*(?:still in (?:it|place)|(?:is|are|was|were) (?:a |the |an )?(?:placeholders?|tokens?|missing|markers?|tags?|template)|placeholders?\b|tokens?\b|tags?\b|markers?\b|syntax\b|stands? for\b|means?\b)", re.I)
QUOTE = "\"'“”‘’`"
NATURAL = re.compile(r"^(?:and void|hypothes[ie]s|results? (?:was|were|is)|of (?:the|us|them|these|those|its|their|our|his|her)|(?:is|are|was|were|has|have|had|will|would|can|could|did|do|does)\b|too\b|other\b|the (?:less|wiser|worse)|but\b)", re.I)

_R = (
    r"(?:page |document |file |filing )?not found|forbidden|access (?:denied|forbidden)|bad gateway|gateway time-?out|service (?:temporarily )?unavailable|internal (?:server )?error|server error"
    r"|too many requests|session (?:has )?expired|gone|unauthori[sz]ed|bad request|request time-?out|method not allowed|temporarily unavailable|conflict|payment required"
    r"|(?:pagina|documento) no encontrad[ao]|no encontrad[ao]|acceso (?:denegado|prohibido)|prohibido|servicio (?:temporalmente )?no disponible|error interno(?: del servidor)?|sesion (?:caducada|expirada)"
    r"|demasiadas (?:solicitudes|peticiones)|no autorizado|puerta de enlace .{0,30}|tiempo de espera agotado"
    r"|(?:page|document) (?:introuvable|non trouvee?)|introuvable|acces (?:refuse|interdit)|interdit|service (?:temporairement )?(?:indisponible|non disponible)|erreur (?:interne|serveur)(?: du serveur)?|session expiree"
    r"|trop de requetes|non autorise|delai (?:d'attente )?depasse|mauvaise passerelle"
)
_THING = r"(?:page|document|filing|article|file|resource|content|story|url|address|report|item)"
_E = (
    rf"(?:(?:we are|we're) )?sorry,? .{{0,40}}(?:can't|cannot|could not|couldn't|not|no longer|gone).{{0,50}}|the {_THING} .{{0,40}}(?:could not|cannot|can't|was not|is not|no longer|does not|doesn't|has been (?:removed|moved)).{{0,50}}"
    rf"|this {_THING} .{{0,20}}(?:no longer|not available|unavailable|removed|expired|cannot be).{{0,50}}|it may have (?:moved|been .{{0,20}})|(?:the )?(?:origin|upstream|server|gateway|host|remote)(?: server| host)? .{{0,20}}(?:did not|didn't|timed out|invalid response|refused|no response).{{0,30}}"
    r"|(?:your )?rate limit .{0,40}|slow down|(?:please )?(?:try|retry|come back|check back) .{0,20}(?:later|again|soon|minutes?|moment).{0,20}|(?:the|this|our) (?:service|site|server|website|system) is .{0,20}(?:down|unavailable|maintenance|offline|overloaded|busy).{0,40}"
    r"|something (?:went|has gone) wrong.{0,40}|an? (?:unexpected |unknown |internal )?error (?:has )?(?:occurred|happened).{0,40}|(?:sorry,? )?you (?:don't|do not) have (?:permission|access|the right).{0,50}|your (?:request|ip|access) (?:was|has been|is) (?:blocked|denied|refused).{0,60}"
    r"|access to this .{0,40}(?:denied|restricted|blocked).{0,30}|(?:please )?(?:sign|log) in (?:again )?to .{0,40}|your session .{0,40}|if the problem persists.{0,50}|go back to .{0,30}|return to the home ?page.{0,20}"
    r"|lo sentimos.{0,60}|el (?:documento|archivo|articulo|contenido|servicio) .{0,40}(?:no existe|no se encuentra|no esta disponible|ya no).{0,40}|la pagina .{0,40}(?:no existe|no se encuentra|no esta disponible|ya no|no pudo).{0,40}|(?:se ha producido|se produjo|ha ocurrido|hubo|ocurrio) un error.{0,50}"
    r"|algo (?:salio|ha salido) mal.{0,30}|(?:vuelva|intente|intentelo|pruebe).{0,30}(?:tarde|nuevo|momento).{0,20}|(?:estamos|sitio|servicio) en mantenimiento.{0,50}|(?:usted )?no tiene (?:permiso|acceso|autorizacion).{0,50}|inicie sesion .{0,40}|su (?:sesion|solicitud) .{0,50}|el servidor .{0,50}|(?:ha superado|supero) el limite.{0,30}"
    r"|une erreur .{0,60}|(?:veuillez )?reessaye[zr].{0,30}|le (?:document|fichier|contenu|service) .{0,40}(?:n'existe plus|n'existe pas|introuvable|n'est plus|indisponible|n'est pas).{0,40}|la page .{0,40}(?:n'existe|introuvable|n'est plus|n'a pas).{0,40}|vous n'(?:avez pas|etes pas) .{0,50}|(?:nous sommes )?desolee?s?,? .{0,60}"
    r"|(?:site|service) en (?:cours de )?maintenance.{0,40}|(?:veuillez )?vous (?:re)?connecter.{0,40}|votre (?:session|requete|demande) .{0,50}|le serveur .{0,50}|la limite .{0,40}"
)
_N = r"(?:0[:. -]*)"
ERROR = re.compile(
    rf"(?:http/0 ?)?(?:(?:error|erreur)[: ]*)?(?:http )?{_N}?(?:[-:|] *)?(?:{_R}|{_E})(?:[,;:.|-]+ ?(?:{_R}|{_E}))*(?: {_N})?"
    rf"|(?:http/0|error|erreur)[: ]*{_N}?|traceback \(most recent call last\)|file \".{{1,80}}\", line 0(?:, in .{{1,40}})?|[a-z_.]*(?:error|exception)(?:: .{{0,120}})"
    r"|retry-after: ?0|(?:(?:reference|request|ray|trace|incident|support|error|cloud|session)(?: (?:id|no|number|code))?|req)[:# -]*(?:0[: -]*)*|0|at [\w.$]+\([\w.]+:?0?\)"
)
ERROR_JSON = re.compile(r'\{\s*"errors?"\s*:.*\}', re.S)
_J = r"(?:java ?script|scripts?|cookies?|cookies and (?:java ?script|scripts?)|(?:java ?script|scripts?) and cookies)"
SCRIPT = re.compile(
    rf"(?:please )?(?:enable|activate|turn on|allow|switch on|permit) {_J}(?:[ ,.].{{0,70}})?|{_J} (?:is|are|must be|has to be|have to be|needs? to be|seems? to be|appears? to be) (?:required|disabled|needed|off|switched off|turned off|allowed|enabled|blocked|necessary|not enabled|not available)(?:[ ,.].{{0,60}})?"
    rf"|(?:you|your browser|this (?:site|page|application|app|website|article|service)|our (?:site|page)|the (?:site|page)) (?:need to|needs?|must|requires?|does not work without|doesn't work without|cannot (?:work|run) without|will not work without|relies on|has|should).{{0,40}}{_J}.{{0,50}}"
    rf"|we(?: have|'ve)? (?:detected|noticed|found) that {_J} .{{0,50}}|to (?:verify|confirm|check|prove|show) (?:that )?you (?:are|'re) (?:not a robot|human|a human).{{0,60}}|(?:verifying|checking) (?:that )?(?:your browser|you are human|if the site connection).{{0,50}}|your browser (?:is|does not|doesn't|has|blocks).{{0,70}}"
    r"|veuillez (?:activer|autoriser) (?:java ?script|les scripts|les cookies).{0,70}|(?:java ?script|ce site|cette page|cette application|l'affichage|votre navigateur).{0,30}(?:necessaire|requis|necessite|desactive|exige|a besoin|obsolete|ne fonctionne pas sans|javascript).{0,50}|activez (?:java ?script|les scripts|les cookies).{0,60}|pour continuer,? .{0,20}(?:java ?script|scripts|cookies).{0,30}"
    r"|(?:por favor,? )?(?:active|activa|habilite|habilita|permita) (?:java ?script|los scripts|las cookies).{0,70}|(?:este sitio|esta pagina|esta aplicacion|su navegador|el sitio|java ?script).{0,30}(?:necesita|requiere|necesario|desactivado|no funciona sin|obsoleto|esta deshabilitado|javascript).{0,50}|(?:debe|necesita) (?:activar|habilitar) .{0,60}"
    r"|loading(?: .{0,30})?|scripts must be allowed|cargando|chargement(?: en cours)?|please wait.{0,30}|un momento.{0,20}|veuillez patienter.{0,20}"
)
_P = r"(?:body|headline|story|text|article|copy|content|lead|summary|quote|caption|chart|title|photo|image|table|figure|paragraph|byline|deck|intro|subhead|graphic|link|date|name)"
FILLER = re.compile(
    r"lorem ipsum.*|(?:(?:todo|tbd|fixme|tk)\b[: ]*(?:[a-z]+ ){0,4}[a-z]*[ ,;]*)+|(?:x{3,}[ ,]*)+(?:x{2,})?|(?:bla+h? ?,? ?)+(?:more to follow)?,?.{0,20}|more to (?:follow|come)|asdf\w*(?: asdf\w*)*|(?:test(?:ing)? ?){2,}|the quick brown fox .{0,40}"
    rf"|(?:the |your |my )?(?:{_P} ){{0,2}}{_P} (?:to come|to follow|goes here|will (?:appear|go) here|here|placeholder|pending|tbd|tk)(?: .{{0,30}})?|(?:add|insert|place|put|write|enter|check|replace|update) (?:the |a |your |this )?(?:{_P}|{_P}s|figures|numbers|facts|names?|source|sources)(?: (?:here|later|below|above|again))?"
    rf"|(?:dummy|sample|placeholder|filler|test|mock|blind) (?:{_P}|texte?)s?\b.{{0,50}}|(?:pending|placeholder|temporary) {_P}\b.{{0,40}}|{_P}(?: {_P})? \(0 (?:words|characters|lines|signs)\)|\[(?:{_P})\]|(?:this (?:is|space) .{{0,20}}(?:dummy|placeholder|filler|sample).{{0,40}})"
    r"|(?:contenu|titre|texte|article|chapo|legende|resume|suite|citation) (?:a venir|a completer|a remplacer|provisoire|ici|de remplissage|fictif)(?: .{0,40})?|(?:inserer|ajouter|ecrire) (?:le |la |les |un |une )?(?:texte|titre|citation|graphique|photo|resume|legende).{0,20}|faux texte.{0,40}"
    r"|aqui va (?:el|la|los|las|un|una) .{0,40}|(?:texto|contenido|titular|titulo|articulo|resumen|cita) (?:provisional|de prueba|de relleno|de ejemplo|pendiente|por venir|aqui|simulado).{0,40}|(?:insertar|agregar|anadir|escribir|poner) (?:el |la |los |las |un |una )?(?:texto|titulo|titular|cita|grafico|foto|resumen|parrafo).{0,20}|(?:proximamente|contenido proximamente)"
)
#: Short filler that stands in a row with other filler.
RUN = re.compile(
    rf"(?:\b(?:x{{3,}}|bla+h?|test(?:ing)?|(?:asdf|qwer|zxcv|hjkl)\w*|more to (?:follow|come)|(?:todo|tbd|fixme)(?: (?:write|add|fill|complete|check|finish)(?: in| out)?(?: the| a)?(?: {_P}))?)\b|\[{_P}\]"
    rf"|\b(?:the |your |my )?(?:{_P} ){{0,2}}{_P} (?:to come|to follow|goes here|will (?:appear|go) here|here)\b|\b(?:add|insert|place|put|write|enter|check|replace|update) (?:the |a |your |this )?(?:{_P}|{_P}s|figures|numbers|facts|names?|sources?)(?: (?:here|later|below|above|again))?\b)[ ,.;:!?-]*"
)
#: Each alternative of RUN has one of these.
RUN_HINTS = ("xxx", "bla", "test", "asdf", "qwer", "zxcv", "hjkl", "more to ", "todo", "tbd", "fixme", "[", " here", " to come", " to follow", "add ", "insert ", "place ", "put ", "write ", "enter ", "check ", "replace ", "update ")
FURNITURE = re.compile(
    r"(?:©|\(c\)|copyright\b) ?.{0,80}|all rights reserved|todos los derechos reservados|tous droits reserves|distributed by .{0,60}|figures are unaudited|.{0,40} newsroom|\[[\w-]+ 0\]|source: .{0,60}|.{0,40} / internal use / .{0,20}|rev(?:\. ?0)?|reproduction needs leave .{0,40}"
    r"|cookies help us .{0,40}|.{0,12}page not found\? .{0,40}|our page not found|write to the help ?desk|(?:home|terms|privacy|contact|help|search|subscribe|log in|sign in|menu|sitemap|back to top|share|print|skip to content)|powered by .{0,40}|(?:read|see) more|advertisement"
)


#: Every placeholder has one of these; every empty value one of the words.
PLACEHOLDER_HINT = re.compile(r"[{<$@_\[#«*|~^]|%(?:[^\s.,;:)?!]|\.\d)|\(\(|\([A-Za-z]+_|\([a-z]+[A-Z]|\((?i:insert|your|enter|add|tb[acd]\)|tk\)|xx|blank|empty|missing|n/a|no value)|::|!!|\+\+|\b[A-Z]+_|\bX{1,3}[X.,% ]|(?:YYYY|AAAA|[/.-]YY|[/.-]AA)\b")
EMPTY_HINTS = ("undefined", "null", "none", "#", "[obj", "n/a", "invalid date", "<na>")
SHORT_HINT = re.compile(r"\b(?:na[nt]|nil)\b")


#: The first characters of these, and the pairs that have no rare one.
RARE = frozenset("{<$@_[#«*|~^%(X")
PAIRED = ("::", "!!", "++", "YY", "AA")


def _hits(s: str) -> Iterator[re.Match[str]]:
    if (not RARE.isdisjoint(s) or any(p in s for p in PAIRED)) and PLACEHOLDER_HINT.search(s):
        yield from PLACEHOLDER.finditer(s)
    low = s.lower()
    if any(h in low for h in EMPTY_HINTS) or SHORT_HINT.search(low):
        yield from EMPTY.finditer(s)


def _placeholder(s: str) -> bool:
    for m in _hits(s):
        a, b = m.span()
        before, after = s[:a], s[b:]
        if SPOKEN_BEFORE.search(before[-60:]) or SPOKEN_AFTER.match(after[:60]):
            continue
        if before[-1:] and before[-1] in QUOTE and after[:1] and after[0] in QUOTE:
            continue
        token = m.group()
        if token.isalpha():
            first = not re.search(r"\w", before)
            if NATURAL.match(after.lstrip()) and (first or token.lower() == "null"):
                continue
            if token.lower() in ("none", "nil") and (token.islower() or (token.isupper() and not s.isupper())):
                continue
            if token.lower() in ("null", "undefined", "nan") and re.search(r"[\"']\s*:\s*$|=\s*$", before):
                continue
        return True
    return False


#: A menu: short entries with bars between them.
MENU = frozenset("|·•›»>–—")
BAR = re.compile(r"[|·•›»]| [/>–—-] ")


def classify(message: str) -> str:
    """placeholder, residue, furniture or content, for one masked message."""
    if _placeholder(message):
        return "placeholder"
    if ERROR_JSON.fullmatch(message.strip()):
        return "residue"
    raw = message.strip()
    parts = [p.strip() for p in BAR.split(raw)] if " / " in raw or not MENU.isdisjoint(raw) else ()
    if len(parts) >= 3 and all(len(p.split()) <= 3 and not re.search(r"\d", p) for p in parts):
        return "furniture"
    s = fold(raw)
    if not re.search(r"[^\W\d_]", s):
        return "furniture"
    if FILLER.fullmatch(s) or SCRIPT.fullmatch(s):
        return "residue"
    #: Runs of filler with other filler between or after them.
    left = RUN.sub(" ", s).strip(" .,;:!?") if any(h in s for h in RUN_HINTS) else s
    unit = AGAIN.fullmatch(left) if _repeats(left) else None
    left = unit[1] if unit else left
    if left != s and (not left or FILLER.fullmatch(left)):
        return "residue"
    if FURNITURE.fullmatch(s) or raw[0] == "©":
        return "furniture"
    if ERROR.fullmatch(s):
        return "residue"
    #: A furniture tail on the same line: an identifier after the message.
    cut = re.sub(r"[.:,;!]* *(?:(?:reference|request|ray|trace|incident)(?: (?:id|no))?[:# ]*)?(?:req-)?0$", "", s) if s.endswith("0") else s
    if cut != s and cut and (SCRIPT.fullmatch(cut) or ERROR.fullmatch(cut)):
        return "residue"
    return "content"


def sift(text: str, source: str = "") -> tuple[dict[str, bool], int]:
    """The masked messages with whether each stands at an edge only, and how many rows of data the text has besides. A text's own source is masked too."""
    said: dict[str, bool] = {}
    n = 0
    for s, data, edge in segments(text):
        if data:
            n += 1
        else:
            m = mask(re.sub(rf"(?<!\w){re.escape(source)}(?!\w)", "source", s) if source and source in s else s)
            said[m] = said.get(m, True) and edge
    return said, n


def _hash(c: str) -> list[Column]:
    """128 bits of identity, so that messages don't merge by chance in a large corpus."""
    return [F.xxhash64(c), F.xxhash64(c, F.lit("again"))]


def _labelled(said: DataFrame, known: DataFrame) -> DataFrame:
    """The messages with what is known of them.

    Hot messages, at most ``HOT`` by their share of all rows, are broadcast; the others shuffle without a hot key.
    """
    total = known.agg(F.sum("n_rows")).first()[0] or 0
    hot = F.col("n_rows") * HOT > total
    often = F.broadcast(known.where(hot).select("m", "class", "wide", "k"))
    first = said.join(often, "m", "left")
    cold = known.where(~hot & ((F.col("class") != "content") | F.col("wide"))).select(F.col("m").alias("cm"), F.col("class").alias("cc"), F.col("wide").alias("cw"), F.col("k").alias("ck"))
    #: Rows that are labelled already, whatever their number, get keys of their own and meet nothing.
    at = F.when(F.col("class").isNull(), F.col("m")).otherwise(F.struct(F.col("m.a"), F.xxhash64("doc_id").alias("b")))
    joined = first.withColumn("at", at).join(cold, (F.col("at") == F.col("cm")) & F.col("class").isNull(), "left")
    return joined.select("doc_id", "text", "rest", F.coalesce("class", "cc", F.lit("content")).alias("class"), F.coalesce("wide", "cw", F.lit(False)).alias("wide"), F.coalesce("k", "ck").alias("k"))


def residue_messages(documents: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(messages of the documents, distinct messages with counts and class).

    Every sentence is a message, as recurrence may decide on any; rows of data travel
    as a number. Messages are counted before they are shuffled, copies of a text as one
    where recurrence is at stake. The classes are worked out once per distinct message,
    and written to the shared folder, as two joins read them.

    messages: doc_id, source, text (hash), rest, m, k, message, edge. distinct: m, k,
    message, class, n_rows, and of all messages of the same key n_documents, n_sources,
    edges (share at the edges) and wide.
    """
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col(text).cast("string").alias("text")).where(
        F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    )
    docs = spread(rows).withColumn("hash", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, said, keys, edges, rest = [], [], [], [], []
            for i, (source, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                messages, n = sift(t, source)
                said += messages
                edges += messages.values()
                keys += map(key, messages)
                at += [i] * len(messages)
                rest += [n] * len(messages)
            own = batch.select([0, 1, 3]).take(pa.array(at, pa.int64()))
            columns = [*own.columns, pa.array(rest, pa.int32()), pa.array(said, pa.string()), pa.array(keys, pa.string()), pa.array(edges, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "text", "rest", "message", "key", "edge"])

    pair = lambda c: F.struct(*(h.alias(n) for h, n in zip(_hash(c), "ab")))
    said = docs.mapInArrow(run, "doc_id long, source string, text long, rest int, message string, key string, edge boolean")
    said = durable(said.select("doc_id", "source", "text", "rest", "edge", "message", pair("message").alias("m"), pair("key").alias("k")), "messages")

    @F.pandas_udf("string")
    def label(messages: pd.Series) -> pd.Series:
        return messages.map(classify)

    recurring = (
        said.groupBy("k", "source")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("edge").alias("e"))
        .groupBy("k")
        .agg(F.sum("n").alias("n_documents"), F.count(F.lit(1)).alias("n_sources"), (F.sum("e") / F.sum("n")).alias("edges"))
        .where(f"n_documents >= {RECURS} and n_sources >= {RECURS}")
    )
    forms = said.groupBy("m").agg(F.count(F.lit(1)).alias("n_rows"), F.min("message").alias("message"), F.min("k").alias("k")).withColumn("class", label("message"))
    distinct = forms.join(recurring, "k", "left").withColumn("wide", F.col("n_sources").isNotNull())
    return said, durable(distinct, "classes")


def residue_documents(documents: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold residue instead of content: doc_id, reason (placeholder, residue, recurring).

    Null, empty and blank texts, data snippets, articles that speak of or quote
    such messages and articles with a service line are none. A repeated doc_id
    gives one row; its rows' messages are taken together. Rows without an id are
    passed over; a null source counts as one source. An empty table gives no rows.
    Extra columns are ignored. However often one text is copied, its sentences don't count as messages of a site.
    """
    said, distinct = residue_messages(documents, text)
    labelled = _labelled(said.select("doc_id", "text", "rest", "m"), distinct)
    unknown = (F.col("class") == "content") & F.col("wide")
    has = lambda c: F.max((F.col("class") == c).cast("int"))
    per_doc = durable(
        labelled.groupBy("doc_id").agg(
            has("placeholder").alias("placeholder"),
            has("residue").alias("residue"),
            F.max("rest").alias("rest"),
            F.max("text").alias("text"),
            F.count_if((F.col("class") == "content") & ~F.col("wide")).alias("content"),
            F.collect_set(F.when(unknown, F.col("k"))).alias("open"),
        ),
        "judged",
    )
    #: Of a document's own messages; its length bounds the set.
    closed = (F.col("rest") == 0) & (F.col("content") == 0)
    reason = F.when(F.col("placeholder") == 1, "placeholder").when(closed & (F.size("open") == 0) & (F.col("residue") == 1), "residue")
    sure = per_doc.withColumn("reason", reason).where("reason is not null").select("doc_id", "reason")
    told = (
        per_doc.select("text", F.explode("open").alias("k"), closed.alias("closed"), "residue")
        .groupBy("k", "text")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("residue").alias("beside"), F.max(F.col("closed").cast("int")).alias("closed"))
    )
    shares = told.groupBy("k").agg(F.count(F.lit(1)).alias("n_texts"), F.avg("closed").alias("closed"), (F.sum("beside") / F.sum("n")).alias("beside"))
    edges = distinct.where("wide").groupBy("k").agg(F.max("edges").alias("edges"))
    wide = F.col("n_texts") >= WIDE
    alone = F.when(wide & (F.col("closed") >= PURE) | (F.col("beside") >= BESIDE), "residue").when(wide & (F.col("edges") >= EDGE), "furniture")
    judged = shares.join(edges, "k").withColumn("told", alone).where("told is not null").select("k", "told")
    #: Only closed texts hang on what recurs alone.
    hang = per_doc.where(closed & (F.size("open") > 0) & (F.col("placeholder") == 0)).select("doc_id", "residue", F.explode("open").alias("k"))
    weak = (
        hang.join(judged, "k", "left")
        .groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("a"), F.count("told").alias("b"), F.max(F.col("residue") + F.coalesce((F.col("told") == "residue").cast("int"), F.lit(0))).alias("residue"))
        .where("a = b and residue > 0")
        .select("doc_id", F.lit("recurring").alias("reason"))
    )
    return sure.unionByName(weak)


def without_residue(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The corpus without the residue documents."""
    return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
