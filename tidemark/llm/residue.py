"""Template residue, filler, and error, access or script notices in place of content.

Two detectors over whole texts. Unfilled template fields are found by their
marks, outside code spans, code blocks and quotation marks. Filler and notices
are found by a multi-pattern automaton over the words of the text: every line
and every sentence is measured by the share of its letters that phrases cover,
and is residue when that share is high and a telling phrase is among them; a
sentence that only writes about such things is mostly made of other words. A
text's coverage is the share of its letters that lie in residue; one of
``MIN_COVERAGE`` or more is excluded as a whole, while ``holds_residue`` tells
whether there is any, as a notice may stand in place of a part only.

Defined cases: a null or empty text is no residue; repeated and equal texts
each give their own row; very long texts are read whole; an empty table gives
an empty result; other columns are left out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.tokens import spread

#: Share of a line's or sentence's letters that phrases must cover.
MIN_SHARE = 0.6
#: Share of a document's letters that must lie in residue for it to be excluded as a whole.
MIN_COVERAGE = 0.5

# Telling phrases. One alone can make a line residue if it covers enough of it.
TELLING = """
enable javascript | activate javascript | turn on javascript | switch on javascript | allow javascript | javascript is disabled | javascript is turned off
javascript is not enabled | javascript is required | javascript required | requires javascript | needs javascript | javascript must be enabled | without javascript
enable scripts | allow scripts | scripts turned on | switch on scripting | scripting is disabled | scripts are disabled | scripts are blocked | does not support scripts | support javascript | works only with scripts
not a robot | you are human | checking your browser | verify you are | browser is out of date | browser is not supported | unsupported browser | outdated browser | update your browser | update it to load | settings of your browser
we use cookies | this site uses cookies | accept all cookies | enable cookies | cookies are disabled | manage your choices
access denied | access is denied | access forbidden | request was blocked | request has been blocked | you do not have permission | not authorized to view | session has expired | session expired | session timed out
sign in again | log in again | please sign in | please log in | sign in to continue | log in to continue | you must be logged in | login required | subscribe to continue | subscribers only
page not found | not found error | page you were looking for | page you requested | page you are looking for | page cannot be found | page could not be found | page does not exist | page no longer exists | could not find the page | not found | file not found
requested path was not served | requested url was not found | could not be served | back to the start page
bad gateway | gateway timeout | gateway time out | service unavailable | service temporarily unavailable | internal server error | too many requests | bad request | method not allowed | forbidden | unauthorized | request timeout | site cannot be reached | connection refused | connection timed out
something went wrong on our side | something went wrong | an error occurred | an error has occurred | unexpected error | application error | server error | sending requests too quickly | rate limit exceeded | too many redirects
upstream connect | reset before headers | reset reason | no healthy upstream | down for maintenance | under maintenance | be back shortly | be back soon | under construction | temporarily unavailable | temporarily offline
traceback most recent call last | stack trace | fatal error | uncaught exception | unhandled exception | null pointer exception | object object | undefined undefined | segmentation fault
lorem ipsum | dolor sit amet | consectetur adipiscing | your text here | text goes here | text to follow | sample text | dummy text | dummy paragraph | placeholder copy | placeholder text | filler text | example text | insert text here | content goes here | title goes here | type here | enter text here
coming soon | description coming soon | no description yet | no description available | no summary has been written | nothing here yet | to be written | replace this paragraph | replace this text | delete this line | write something about your | first entry of your | add your text | add a description
default description | edit it in the settings | this is a default | hello world welcome to wordpress | just another wordpress site | untitled document | check back later | loading loading | please wait while | this is a sample page
javascript aktivieren | aktivieren sie javascript | javascript ist deaktiviert | javascript ist ausgeschaltet | skripte sind deaktiviert | javascript wird benotigt | schalten sie javascript ein
seite nicht gefunden | seite wurde nicht gefunden | zugriff verweigert | zugriff gesperrt | sitzung ist abgelaufen | interner serverfehler | dienst nicht verfugbar | ein fehler ist aufgetreten | es ist ein fehler aufgetreten | etwas ist schiefgelaufen | wartungsarbeiten | wir verwenden cookies | adresse wurde verschoben | seite existiert nicht
hier steht ihr text | hier steht dein text | ihr text hier | platzhaltertext | blindtext | beispieltext | mustertext | text folgt | inhalt folgt | beschreibung folgt
active javascript | activar javascript | activa javascript | habilite javascript | habilitar javascript | javascript esta desactivado | javascript esta deshabilitado | pagina no encontrada | acceso denegado | error interno del servidor | servicio no disponible | su sesion ha caducado | la sesion ha expirado | se ha producido un error | algo salio mal | utilizamos cookies | su texto aqui | tu texto aqui | texto de ejemplo | texto de relleno | proximamente | en mantenimiento
activer javascript | activez javascript | javascript est desactive | page introuvable | page non trouvee | cette page n existe plus | cette page n existe pas | acces refuse | acces interdit | erreur interne du serveur | service indisponible | votre session a expire | une erreur est survenue | une erreur s est produite | nous utilisons des cookies | votre texte ici | texte d exemple | faux texte | texte a venir | bientot disponible | en maintenance
abilita javascript | attiva javascript | abilitare javascript | pagina non trovata | accesso negato | errore interno del server | ative o javascript | habilite o javascript | pagina nao encontrada | acesso negado | schakel javascript in | pagina niet gevonden | toegang geweigerd | wlacz javascript | nie znaleziono strony | aktivera javascript
скрипты отключены | включите javascript | javascript отключен | страница не найдена | доступ запрещен | внутренняя ошибка сервера | обновите страницу | произошла ошибка | сессия истекла | увімкніть javascript
请启用 javascript | 请启用javascript | 页面未找到 | 访问被拒绝 | javascriptを有効にして | ページが見つかりません | 자바스크립트를 활성화 | يرجى تفعيل جافا سكريبت
"""

# The grammar of notices that ask for scripts or cookies: an asking verb and a thing, or a thing and its state, by language (verbs | things | states).
ASKING = {
    "en": (
        "enable | activate | allow | turn on | switch on | re enable | unblock | permit | enabling | turning on | allowing",
        "javascript | java script | js | scripts | scripting | cookies | javascript and cookies | cookies and javascript | your javascript | third party cookies | browser cookies",
        "is disabled | is turned off | is switched off | is off | is not enabled | is not supported | is not available | is required | is blocked | is needed | must be enabled | must be turned on | needs to be enabled | seems to be disabled | appears to be disabled | seems to be turned off | appears to be turned off | has been disabled | are disabled | are turned off | are blocked | are required | must be allowed | disabled in your browser | turned off in your browser | is currently disabled",
    ),
    "de": (
        "aktivieren sie | aktiviere | aktivieren | erlauben sie | erlaube | schalten sie | einschalten | zulassen",
        "javascript | js | skripte | cookies | das javascript | ihr javascript",
        "aktivieren | einschalten | ist deaktiviert | ist ausgeschaltet | ist nicht aktiviert | wird benotigt | wird nicht unterstutzt | muss aktiviert sein | scheint deaktiviert zu sein | sind deaktiviert | zulassen",
    ),
    "fr": (
        "activer | activez | autoriser | autorisez | reactivez",
        "javascript | js | le javascript | les scripts | les cookies",
        "est desactive | est requis | est necessaire | n est pas active | doit etre active | semble etre desactive | sont desactives | sont requis",
    ),
    "es": (
        "habilitar | habilite | habilita | activar | active | activa | permitir | permita",
        "javascript | js | los scripts | las cookies",
        "esta desactivado | esta deshabilitado | es necesario | no esta habilitado | debe estar habilitado | parece estar desactivado | estan desactivadas",
    ),
    "it": ("abilitare | abilita | attivare | attiva | abilitate", "javascript | i cookie", "e disabilitato | e disattivato | e necessario | non e abilitato"),
    "pt": ("ative | ativar | habilite | habilitar | permita", "javascript | o javascript | os cookies", "esta desativado | esta desabilitado | e necessario"),
}

# Further telling phrases, of gates, databases and empty or moved pages.
GATES = """
you have been blocked | have i been blocked | are unable to access | unable to access this site | you are being rate limited | you have been rate limited | attention required | checking if the site connection is secure | review the security of your connection
complete the security check | complete the captcha | solve the captcha | verifying you are human | verify you are human | ddos protection by | just a moment | press and hold to confirm | unusual traffic from your computer network | this request was blocked by | security service to protect itself
error establishing a database connection | could not connect to the database | database connection failed | too many connections | this site can t be reached | this webpage is not available | took too long to respond | server is temporarily unable to service your request | the server encountered an internal error
this account has been suspended | this domain is for sale | this domain has expired | website is currently unavailable | site is currently unavailable | content is not available in your country | content is not available in your region | not available in your region | this video is unavailable | you must be signed in | sign up to continue | create an account to continue | please disable your ad blocker | ad blocker detected | turn off your ad blocker
vous devez vous connecter | veuillez vous connecter | sie mussen sich anmelden | bitte melden sie sich an | debe iniciar sesion | inicie sesion para continuar | zu viele anfragen | trop de requetes | demasiadas solicitudes | fehler beim herstellen einer datenbankverbindung
"""

# Words that fill the rest of such lines but tell nothing by themselves.
FILLING = """
please | sorry | oops | whoops | error | code | status | message | trace | reference | incident | request id | page | this page | this app | this site | this website | this dashboard | the page | the page you | the order book | this collection | the site
to view | to see | to use | to run | to load | to continue | to go on | reading | your | you | your browser | browser | it | in | on | or | and | the | a | an | is | are | was | were | has been | have been | by | of | then | we | we will | will | be | i | id
try again | try again later | come back | in a few minutes | wait | seconds | minutes | and try again | reload | reload the page | refresh | again | later | back | shortly | do not close this tab | this happens automatically | before you continue | before you publish
need to | you need to | turn it on | works only with | change the settings of | verify that | that you are | an extension | by an extension | they are | your request | the gate | blocked | moved or deleted | it may have been | may have been | with | only | all | accept all | manage | choices | choices to continue
could not | find | for | looking for | too quickly | requests | most recent call last | timeout | upstream | headers | connect failure | failure | before | reset | http | https | html | head | title | body | center | h1 | hr | nginx | apache | server | at | port | here | here then | entry | log | yet | two or three sentences work best | check | description | no | not | has | written | been | paragraph | about | something | collection | settings | edit | home | menu | help | contact | skip to content | there | our side
bitte | sie | um | diese | seite | anzuzeigen | anzusehen | die | der | das | wurde | wurden | oder | verschoben | geloscht | fehler | versuchen sie es spater erneut | erneut | ihre | ihr | ist | und | nicht | neu laden
en su navegador | su navegador | para ver | esta pagina | para | ver | su | en | codigo | el | la | por favor | intentelo de nuevo mas tarde | de | y
veuillez | pour | afficher | cette | votre | navigateur | dans votre navigateur | erreur | le | les | et | s il vous plait | reessayez plus tard
sie mussen | mussen | app | anwendung | diese app | auszufuhren | zu verwenden | ihrem browser | in ihrem browser | in | scheint | zu | fortzufahren
vous devez | devez | executer | utiliser | application | cette application | ce site | page | continuer | dans | semble | merci d | merci de | afin de
necesita | necesitas | debe | debes | tiene que | ejecutar | usar | esta aplicacion | aplicacion | este sitio | continuar | navegador | tu navegador | para continuar
our systems have detected | our systems | have | detected | unusual traffic | from your | computer | network | to access | access | connection | connection is secure | seems | have been | run | use | view | required | proceeding | moment | ray id | performance | security | cloudflare | experience | full | functionality | features | for the best | using | web | application | application works | properly | correctly | some | might | and then | try | this | of this | of this site | does not work | will not work | without | doesn t work properly without | we re | re | ll | s | t | don t | can t
и | страницу | чтобы | в | браузере | ошибка | код | пожалуйста
"""

# The syllables that pseudo-Latin filler is built of.
SYLLABLES = "am ar bel cor dol ext fa fan lo lor mi mor nu nus on pta ple quen re sel sit ta tam tis tur ve vis ius ipsum lorem dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud".split()
#: What a hand on a keyboard leaves.
MASH = set("foo bar baz qux quux asdf asdfg asdfgh qwer qwert qwerty zxcv hjkl test tests testing xxx xxxx aaa aaaa bbb yyy zzz blah bla abc abcd jkl dfg lol".split())
#: What a program prints for nothing; residue if a line holds nothing else.
NOTHING = set("undefined null nan nil none nullptr".split())

_FIELD = "[A-Za-z][A-Za-z0-9_. -]*"
# The marks of unfilled template fields.
TEMPLATE = regex.compile(
    rf"\{{\{{[#/^>&!~-]? ?{_FIELD}(?:[|:][^{{}}]*)? ?\}}\}}|[$#]\{{{_FIELD}\}}|<%[=-]? ?[^%<>]+ ?%>|%\({_FIELD}\)[sdfr]|\[\[ ?[a-z][a-z0-9_]* ?\]\]|<<{_FIELD}>>|@@{_FIELD}@@"
    r"|(?<![\w%])%[A-Z][A-Z0-9_]{2,}%(?!\w)|(?<![\w$])\$[A-Z][A-Z0-9_]{2,}\$(?!\w)|(?<!\w)__[A-Z][A-Z0-9_]{2,}__(?!\w)|(?<![\w{}\\^$#%])\{[a-z][a-z0-9_]+\}(?![\w{}])"
    r"|\[(?:your|insert|enter|add|type|choose|fill in)\b[^\[\]\n]+\]|\[[^\[\]\n]+ (?:goes here|here|to be added|to follow)\]|\((?:TBD|TODO|TBC|FIXME)\b[^()\n]*\)|\[(?:TBD|TODO|TBC|FIXME)\b[^\[\]\n]*\]"
    r"|(?<!\w)X{4,}(?!\w)|<(?:your|insert|enter)\b[^<>\n]+>",
)
_INSERT = regex.compile(r"\[(?:YOUR|INSERT|Insert|Your|ENTER|Enter|ADD|Add)\b[^\[\]\n]+\]|<(?:YOUR|INSERT)\b[^<>\n]+>")
_ANGLE = regex.compile(r"<([A-Z][A-Z0-9_]{2,})>")
_CODE = regex.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]*`|<(code|pre|kbd|samp)\b[^<>]*>.*?</\1>|\"[^\"\n]+\"|“[^“”\n]+”|„[^„“”\n]+[“”]|«[^«»\n]+»|(?<!\w)'[^'\n]+'(?!\w)", regex.S | regex.I)
_MARK = regex.compile(r"[{}\[\]<%$@_(]|XXXX")
_HTML = regex.compile(r"<[^<>]*>")
_MARKS, _LETTERS = regex.compile(r"\p{M}+"), regex.compile(r"\p{L}+")
_WORDS = regex.compile(r"\p{L}+(?:\p{M}+\p{L}*)*")
_SENTENCE = regex.compile(r"(?<=[.!?…。])\s+|(?<=[。！？])")
_RAW = regex.compile(r"\[object Object\]|^\s*(?:File \"[^\"\n]+\", line \d+|[A-Z]\w*(?:Error|Exception)(?::.*)?$)", regex.M)


_ASCII_WORDS = {i: chr(i).lower() if chr(i).isalpha() else " " for i in range(128)}
_ASCII_LETTERS = {i: None for i in range(128) if not chr(i).isalpha()}


def _plain(text: str) -> str:
    """Lower case, without accents, words only, one blank between them and at both ends."""
    if text.isascii():
        return " " + " ".join(text.translate(_ASCII_WORDS).split()) + " "
    s = _MARKS.sub("", unicodedata.normalize("NFKD", text.casefold()))
    return " " + " ".join(_LETTERS.findall(s)) + " "


def _size(text: str) -> int:
    """Letters of a text, with their marks."""
    return len(text.translate(_ASCII_LETTERS)) if text.isascii() else sum(len(w) for w in _WORDS.findall(text))


@lru_cache(maxsize=2)
def automaton(only_telling: bool = False):
    """The multi-pattern automaton; a phrase's value is (its length with both blanks, whether it is telling)."""
    import ahocorasick

    a = ahocorasick.Automaton()
    asking = "|".join(f"{x} {y}" for verbs, things, states in ASKING.values() for v in things.split("|") for x, y in [*((verb, v) for verb in verbs.split("|")), *((v, state) for state in states.split("|"))])
    telling_blocks = ((TELLING, True), (GATES, True), (asking, True))
    for block, telling in telling_blocks if only_telling else ((FILLING, False), *telling_blocks):
        for phrase in block.replace("\n", "|").split("|"):
            if phrase.strip():
                a.add_word(_plain(phrase), (len(_plain(phrase)), telling))
    a.make_automaton()
    return a


_TILES = regex.compile(rf"(?:{'|'.join(sorted(set(SYLLABLES), key=len, reverse=True))})+")


class _Fillers(dict):
    """What a word can be: l (pseudo-Latin), k (keyboard filler), b (both) or blank; remembered for short words."""

    def __missing__(self, word: str) -> str:
        latin, mash = _TILES.fullmatch(word) is not None, word in MASH
        kind = "b" if latin and mash else "l" if latin else "k" if mash else " "
        if len(word) < 24 and len(self) < 1_000_000:
            self[word] = kind
        return kind


_FILLERS = _Fillers()
# Of six words or more with 85 % filler, three successive ones are filler: a text without such a run needs no closer look.
_RUN = regex.compile("[lb]{3}|[kb]{3}")
_BARE = regex.compile(rf" (?:{'|'.join(sorted(NOTHING))}) ")


def _suspect(text: str) -> bool:
    """Whether any line or sentence of the text can be residue; never False where ``segment_kind`` finds one.

    Without tags the words of a line or sentence are successive words of the
    text. Tags are stripped from a line or sentence by itself, which can't be
    told from the whole text, so a text with a ``<`` is always looked at.
    """
    if "<" in text or "Error" in text or "Exception" in text or "[object Object]" in text or 'File "' in text:  # the last four: all of _RAW
        return True
    plain = _plain(text)
    return next(automaton(True).iter(plain), None) is not None or _BARE.search(plain) is not None or _RUN.search("".join(map(_FILLERS.__getitem__, plain.split()))) is not None


def _phrases(plain: str) -> tuple[float, bool]:
    """(share of the letters covered by phrases, whether a telling one is among them)."""
    spans, telling = [], False
    for end, (n, tells) in automaton().iter(plain):
        begin, telling = end - n + 2, telling or tells
        while spans and spans[-1][1] >= begin:  # matches come in order of their ends
            begin = min(begin, spans.pop()[0])
        spans.append((begin, end))
    letters = len(plain) - plain.count(" ")
    covered = sum(b - a - plain.count(" ", a, b) for a, b in spans)
    return (covered / letters if letters else 0.0), telling


def _filler(words: list[str]) -> bool:
    """Pseudo-Latin or keyboard filler: nearly all of six words or more."""
    if len(words) < 6:
        return False
    kinds = "".join(map(_FILLERS.__getitem__, words))
    both = kinds.count("b")
    return max(kinds.count("l"), kinds.count("k")) + both >= 0.85 * len(words)


def segment_kind(line: str) -> str | None:
    """'filler', 'notice' or None for one line or sentence."""
    raw = _RAW.sub(" ", line)
    if raw != line and not regex.search(r"\p{L}", raw):
        return "notice"
    plain = _plain(_HTML.sub(" ", line) if "<" in line else line)
    words = plain.split()
    if not words:
        return None
    if _filler(words):
        return "filler"
    if all(w in NOTHING for w in words):
        return "notice"
    share, telling = _phrases(plain)
    if telling and share >= MIN_SHARE:
        return "notice"
    return None


def template_fields(text: str) -> tuple[int, int]:
    """(unfilled template fields in the text's own wording, their letters)."""
    if not _MARK.search(text) or not (TEMPLATE.search(text) or _INSERT.search(text) or _ANGLE.search(text)):
        return 0, 0
    own = _CODE.sub(" ", text)
    found = [m.group() for p in (TEMPLATE, _INSERT) for m in p.finditer(own)]
    found += [m.group() for m in _ANGLE.finditer(own) if f"</{m.group(1)}>" not in own]
    return len(found), sum(map(_size, found))


def residue(text: str | None) -> tuple[int, int, int, float]:
    """(template fields, filler segments, notice segments, share of the letters in fields, filler and notices)."""
    if not text:
        return 0, 0, 0, 0.0
    (fields, inside), filler, notice, letters = template_fields(text), 0, 0, 0
    if not _suspect(text):
        if not fields:
            return 0, 0, 0, 0.0
        return fields, 0, 0, min(1.0, inside / max(1, _size(text)))
    for line in text.split("\n"):
        if not line.strip():
            continue
        n = _size(line)
        letters += n
        whole = segment_kind(line)
        for part in [line] if whole else _SENTENCE.split(line):
            kind = whole or segment_kind(part)
            if kind:
                inside += n if whole else _size(part)
                filler += kind == "filler"
                notice += kind == "notice"
    return fields, filler, notice, min(1.0, inside / letters) if letters else float(fields + filler + notice > 0)


def find_residue(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, fields, filler, notices (counts), coverage, holds_residue (any of them), excluded (coverage of MIN_COVERAGE or more)."""
    kind = dict(docs.select(doc_id).dtypes)[doc_id]
    slim = spread(docs.select(F.col(doc_id), F.col(text).alias("__text")))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [residue(t) for t in batch["__text"]]
            yield pd.DataFrame({doc_id: batch[doc_id], **{c: [r[i] for r in rows] for i, c in enumerate(("fields", "filler", "notices", "coverage"))}})

    found = slim.mapInPandas(scan, f"{doc_id} {kind}, fields int, filler int, notices int, coverage double")
    return found.withColumns({"holds_residue": (F.col("fields") + F.col("filler") + F.col("notices")) > 0, "excluded": F.col("coverage") >= MIN_COVERAGE})
