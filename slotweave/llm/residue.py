"""Template residue, filler, error pages and script notices that stand in place of content.

Labelled exemplars of such leftovers are held in an inverted index.  Every cell that is no code is cut into
passages; windows of passages retrieve the exemplars with which they share terms, and TF-IDF containment, with
document frequencies counted over the whole corpus, says how much of the window lies in the exemplar and how much
of the exemplar in the window.  A cell is a leftover if windows that match cover nearly all of its weight, so prose
or output that only mentions such text isn't one.

One pass over the texts counts document frequencies and keeps the few cells with mostly exemplar terms; only these
are scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache
from http import HTTPStatus
from http.server import DEFAULT_ERROR_MESSAGE

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.llm.cells import CODE, MARKDOWN, read_cells
from slotweave.workspace import materialize

# Labelled exemplars, by what they are.  Numbers don't count; § stands for any unfilled placeholder.  Besides these the
# index holds the status phrases, their descriptions and the error page of Python's own HTTP modules.
# Fixed values:
MESSAGES = {
    "error": [
        "Page not found. The page you are looking for does not exist or has been moved.",
        "Sorry, we could not find the page you requested. Go back to the home page.",
        "Error: not found. Return to the start page or try a search.",
        "The requested URL was not found on this server. That's an error. That's all we know.",
        "Access denied. You do not have permission to access this resource on this server. Reference",
        "You are not authorized to view or open this file or page. Contact the administrator.",
        "Bandwidth limit exceeded. The server is temporarily unable to service your request. Please try again later.",
        "Rate limit exceeded. Too many requests, please slow down and wait a few seconds or minutes before you retry.",
        "Service temporarily unavailable. The server is busy, overloaded or down for scheduled maintenance. Please check back soon or retry later.",
        "Internal server error. Something went wrong on our end. Request id, trace id, ray id, edge",
        "Oops! An unexpected error occurred. Sorry, something broke. Please reload or refresh the page and try again?",
        "The upstream server is not responding: connection timed out at the gateway.",
        "This site can't be reached. The server refused to connect, or took too long to respond. Check your connection.",
        "Bad gateway. Error at the proxy: the host returned an invalid response. nginx apache cloudflare",
        "Your session has expired or timed out. Please log in or sign in again to continue.",
        "You must be signed in to view this content. Log in to continue.",
        "The file could not be loaded or displayed. It is no longer available, was moved, deleted or renamed.",
        "Unable to render this document. The notebook failed to load or render. We could not open or show it.",
        "The preview is not available. Download the file to view it in a viewer.",
        "The content you asked for isn't available right now. The link may be broken, or the page may have been removed.",
        "error code status message not_found forbidden unauthorized internal_error detail trace null false true",
        "html head title body center h hr p div error not found forbidden gateway time-out timeout bad service unavailable nginx",
        "The page you were looking for doesn't exist. You may have mistyped or entered the wrong address, or the link is outdated.",
        "The link, page or session you followed or requested has expired or is invalid. We could not process or complete your request at this time.",
        "The server encountered an error or a problem and could not complete or process your request. Backend is unhealthy. Failed to fetch.",
        "Oh no! This document, notebook or archive has been deleted by its owner or author. Your connection was interrupted. Login to continue.",
        "Das Dokument oder die Datei konnte nicht geladen oder gefunden werden. Contenu, document ou fichier indisponible. Archivo o documento no encontrado.",
        "There is a problem with the resource, and it cannot be displayed, opened or processed. Contact the site owner, administrator or support team.",
        "Error establishing a connection to the database, host or server. Unable to connect. The network is unreachable.",
        "This account, domain, site or service has been suspended, disabled or closed.",
        "You have been blocked by the security policy or firewall of this site. Unable to access. Your request has been denied.",
        "This content, video or file is not available in your region or country. It may be private, restricted or deleted.",
        "Invalid or bad request. Please try again. Something broke on our side. An error occurred.",
        "That's an error. That's all we know. Error code, error number, error id. An unknown error has occurred.",
        "Please log in, sign in or register to view, open or edit this page, document or notebook. Login required. Authentication required.",
        "Error loading notebook, file or data. This file could not be previewed, rendered, loaded or displayed. Preview failed.",
        "Access denied. Access forbidden. Reference number or error reference. Not allowed.",
        "{\"error\": \"not_found\", \"message\": \"not found\", \"code\": 1, \"status\": 1, \"detail\": null, \"trace\": 1, \"path\": null}",
        "Zugriff nicht erlaubt oder verboten. Fehler beim Laden. Verbindung fehlgeschlagen. Zeitüberschreitung. Bitte melden Sie sich an.",
        "Erreur : le serveur a rencontré un problème ou une erreur. Accès interdit. Délai dépassé. Connectez-vous pour continuer.",
        "Error: acceso prohibido o restringido. El servidor encontró un problema. Tiempo de espera agotado. Inicie sesión para continuar.",
        "Under construction. This page or site is coming soon. Check back later.",
        "Whoops, looks like something went wrong. Oops, that didn't work. We are having trouble loading this page, content, file or notebook.",
        "Application error: a server or client-side exception has occurred. Error occurred while the application was loading; see the log for details.",
        "Error: backend fetch failed. Cache server, cluster, origin host, proxy or upstream connect error. Guru meditation.",
        "Loading failed. The request could not be completed or processed. Refresh or reload the page to retry, or contact support.",
        "This page isn't working right now. The web site didn't send any data, can't be found, is offline or down.",
        "You don't have permission to view or access this page, file, directory or resource. Access is forbidden or restricted; request access.",
        "The requested resource, file, document, item or page was not found, does not exist, was deleted, removed or moved, or is gone.",
        "Request entity or payload too large. Request timeout. Request has been blocked, denied, rejected or refused by the server.",
        "Your login or session timed out or is no longer valid. Sign in, log in or reload to continue.",
        "The connection to the server was reset, lost, closed or interrupted, or timed out. The gateway did not respond in time.",
        "Sorry, we couldn't render, open, load, show or display this notebook, file or preview. Try again or download it.",
        "Too many requests. You have been rate limited or reached the limit of requests. Wait some time, slow down and retry again.",
        "The service or server is busy, overloaded, temporarily down or unavailable. Come back or try later.",
        "<html><head><title>Error</title></head><body><h1>Error: bad gateway, gateway time-out, service unavailable, internal server error</h1><center><hr></center></body></html>",
        "Seite nicht gefunden. Fehler. Die angeforderte Seite konnte nicht gefunden werden oder existiert nicht mehr.",
        "Zugriff verweigert. Sie haben keine Berechtigung. Der Server ist nicht erreichbar oder nicht verfügbar.",
        "Page introuvable. Erreur. La page demandée n'existe pas ou plus. Accès refusé, service indisponible.",
        "Erreur interne du serveur. Veuillez réessayer plus tard. Cette page n'est pas ou plus disponible; page introuvable.",
        "Die Seite existiert nicht oder wurde verschoben oder gelöscht. Interner Serverfehler. Bitte versuchen Sie es später erneut. Fehler, Seite nicht gefunden.",
        "La página no existe, fue eliminada o movida. Página no encontrada. Vuelva al inicio.",
        "Página no encontrada. Error. La página solicitada no existe o no se encuentra. Acceso denegado.",
        "Error interno del servidor. Servicio no disponible. Inténtelo de nuevo más tarde.",
    ],
    "script": [
        "Please enable JavaScript and cookies in your browser to continue.",
        "You need to enable JavaScript to run this app.",
        "We're sorry, but this page doesn't work or run properly without JavaScript (JS) enabled. Please enable it to continue. noscript",
        "JavaScript is disabled or blocked in your browser settings. Turn it on and reload the page.",
        "JavaScript is required to view this site, page, notebook, content or viewer.",
        "This application requires, needs or uses scripts, which must be switched on, allowed or activated. Scripts are blocked.",
        "Your browser does not support or run scripts or JavaScript, so this widget or content cannot be shown or displayed.",
        "Interactive output, widgets and scripts are hidden, disabled or blocked for untrusted notebooks, or because this notebook is not trusted.",
        "Checking your browser before you access the site... This process needs JavaScript. Just a moment. Ray ID",
        "Scripts are disabled; enable or allow them to see the map or widget.",
        "To use this app or viewer, enable JavaScript for this site in your browser and reload the page.",
        "JavaScript and cookies are turned off. Turn them on to continue and view this notebook.",
        "Pour utiliser cette application ou ce site, veuillez activer JavaScript dans votre navigateur. JavaScript est nécessaire ou requis pour afficher cette page.",
        "Diese App oder Seite funktioniert nur mit aktiviertem JavaScript. Bitte aktivieren oder erlauben Sie JavaScript, um die Inhalte anzuzeigen.",
        "Necesita o debe habilitar o activar JavaScript para usar esta aplicación, ver esta página o este contenido en su navegador.",
        "You have scripts or JavaScript disabled or turned off; switch them on, enable them and reload to view or use the site.",
        "JavaScript must be enabled in order for you to use, view, see or run this page, app or notebook in standard view.",
        "This viewer, widget, app, site or page needs, uses or requires JavaScript, scripts or cookies to be enabled, activated, allowed or switched on.",
        "Please turn on, activate or allow scripts. We're sorry, the viewer doesn't work or function without them.",
        "The widget, output or content is hidden and cannot be rendered, since your browser blocks scripts and does not run them.",
        "Checking if the site connection is secure. Verify you are human; this check needs JS and cookies. Checking your browser. Ray",
        "Um fortzufahren, aktivieren Sie bitte JavaScript; diese Anwendung oder Seite wird sonst nicht angezeigt.",
        "Activez JavaScript pour voir cette page, ce site ou ce contenu. JavaScript est désactivé; merci de l'activer.",
        "Active JavaScript para continuar, para ver esta página o usar este contenido. JavaScript está desactivado; actívelo.",
        "Bitte aktivieren Sie JavaScript in Ihrem Browser, um diese Seite anzuzeigen oder die Anwendung zu nutzen.",
        "JavaScript ist deaktiviert. Diese Seite benötigt JavaScript.",
        "Veuillez activer JavaScript dans votre navigateur pour afficher cette page ou ce contenu et continuer.",
        "Por favor, active o habilite JavaScript en su navegador para ver este contenido, esta página o continuar.",
    ],
    "dummy": [
        "This is some placeholder text. Some placeholder copy. Replace this paragraph, sample or heading with your own text, words or content.",
        "Your text goes here. Add, enter, type, write or insert your text, title, description or content here.",
        "Edit this cell to add content. Click or double-click to edit this text block.",
        "Your name here. Your title here. Replace this text with your introduction, summary, description or notes. Write something here.",
        "Text text text. xxxxx xxxxx xxx xxxx. asdf asdf. blah blah. bla bla bla. test test.",
        "Sample heading, sample paragraph, some copy. Replace the placeholder with words of your own. Add text, content or notes to this cell.",
        "Dies ist Blindtext, hier steht später Text. Ceci est du texte de remplissage. Este es texto de relleno.",
        "Heading Subheading Title Paragraph Caption: sample text, dummy text, text text text text.",
        "Hier steht Blindtext. Hier steht Ihr Text, ein Platzhalter. Dies ist ein Blindtext, Mustertext.",
        "Texte de remplissage. Votre texte ici. Ceci est un faux texte, texte d'exemple.",
        "Texto de relleno. Su texto aquí. Este es un texto de ejemplo o de prueba.",
        "blah blah blah, foo bar baz, test test test, xxx xxxx xxxxx xxxxxx asdf qwerty",
    ],
}
# Short exemplars that a message of each kind must hold one of, whole.
_COMMON = (
    "the a an to this that of in on at for is are was were be been it its has have had not no or and you your we our us please sorry if here it's may can cannot will does do by from with them there any some all so but only"
    " der die das den und oder ist nicht bitte sie um zu zum diese dieser dieses ein eine in auf mit für wird wurde ihr ihre"
    " le la les un une des du de et est pas pour ce cette vous votre vos veuillez dans sur"
    " el los las una y es no para por favor este esta su en se"
)
KERNELS = {
    "error": [
        "not found", "could not find", "does not exist", "no longer available", "not available", "isn't available", "access denied", "permission denied", "no permission", "do not have permission", "not authorized",
        "that's an error", "doesn't exist", "cannot be displayed", "unable to connect", "unable to access", "error establishing", "been suspended", "been denied", "been removed", "invalid request", "something broke", "login required", "authentication required", "log in to view", "sign in to view", "error loading", "could not be previewed", "nicht erlaubt", "fehler beim laden", "fehlgeschlagen", "rencontré un problème", "rencontré une erreur", "accès interdit", "acceso prohibido",
        "has expired", "could not process", "could not complete", "encountered an error", "encountered a problem", "been deleted", "connection interrupted", "continue login", "failed to fetch", "konnte nicht geladen", "indisponible", "no encontrado", "having trouble", "error occurred", "error has occurred", "exception occurred", "fetch failed", "loading failed", "connect error", "isn't working", "didn't work", "can't be found", "has been blocked", "don't have permission", "existiert nicht", "interner serverfehler", "no existe", "looks like wrong", "connection reset", "connection lost", "rate limited",
        "must be signed in", "log in to continue", "sign in again", "session expired", "timed out", "connection refused", "refused to connect", "can't be reached", "cannot be reached", "not responding",
        "something went wrong", "unexpected error", "internal_error", "not_found", "limit exceeded", "too many requests", "slow down", "temporarily unavailable", "temporarily unable", "down for maintenance",
        "server busy", "server error", "try again later", "failed to load", "failed to render", "could not render", "could not load", "could not open", "could not be loaded", "could not be displayed", "unable to render", "unable to load", "unable to open", "unable to display",
        "was moved", "was deleted", "was removed", "may be broken", "preview not available", "under construction", "coming soon", "invalid response", "gateway time-out", "service unavailable",
        "nicht gefunden", "nicht erreichbar", "nicht verfügbar", "zugriff verweigert", "keine berechtigung", "introuvable", "n'existe pas", "accès refusé", "service indisponible", "erreur interne",
        "no encontrada", "no se encuentra", "acceso denegado", "no disponible", "error interno",
    ],
    "script": ["javascript", "enable javascript", "javascript disabled", "javascript required", "without javascript", "javascript enabled", "javascript to", "activer javascript", "aktivieren javascript", "active javascript", "scripts", "run scripts", "enable scripts", "scripts blocked", "scripts disabled", "needs scripts", "noscript", "js browser", "js cookies"],
    "dummy": [
        "placeholder text", "placeholder copy", "sample text", "dummy text", "text here", "content here", "title here", "description here", "your own words", "replace paragraph", "edit cell", "add content", "edit text", "text text text",
        "name here", "replace text", "replace this", "bla bla", "blindtext", "mustertext", "hier steht ihr text", "remplissage", "faux texte", "votre texte", "relleno", "su texto", "texto de ejemplo", "blah blah", "foo bar baz", "test test test", "xxx xxx", "xxxx xxxx", "xxxxx xxxxx", "asdf asdf", "qwerty qwerty",
    ],
}
ALONE = {"Forbidden", "Unauthorized", "introuvable"}  # say enough without another word
TEMPLATES = [
    "§",
    "Project § by §. Version §",
    "Data: § Method: § Result: § Conclusion: § Source: §",
    "Description: § Goal: § Purpose: § Summary: §",
    "Title: § Subtitle: § Author: § Date: § Name: § Email: § Course: § Instructor: § License: §",
    "Title: § by § Author: § Date: § Data: § Method: § Result: § Goal: § Description: §",
    "Dear §, Hello § Hi § Sincerely, §",
]
LOREM = (  # the classical filler text; a window of only such words is filler, whatever their order
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim"
    " veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu"
    " fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
    " sed perspiciatis unde omnis iste natus error voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis"
    " quasi architecto beatae vitae dicta explicabo nemo ipsam quia voluptas aspernatur aut odit fugit consequuntur magni dolores eos ratione sequi nesciunt"
    " neque porro quisquam dolorem numquam eius modi tempora incidunt magnam aliquam quaerat"
)
_SEEDS = {"lorem", "ipsum"}
# Frequent words of running text in four languages, without those that the classical filler text uses.  Fixed values:
_FUNCTION = frozenset(
    "the a an of to is are was were be been it its this that these those and or but if then for with from by on at as we you he she they our your not no can will have has had which"
    " when what how why der die das und oder ein eine ist sind war nicht mit von auf für wir ihr dem den des zu im le la les un une des du de est sont avec pour dans sur pas nous que qui"
    " el los las una y o es son con para por se del al".split()
)
# Ways to write a placeholder, each with the signs of which it holds one.  Fixed values:
_NAME, _WORDS = r"[\w.\-]+", r"[\w.\-]+(?: [\w.\-]+)*"
_OPENED = ["insert", "enter", "your", "add", "type", "write", "put", "fill in", "replace", "choose", "select", "votre", "vos", "insérez", "entrez", "escriba", "inserte", "introduzca", "ihr", "ihre"]
_CLOSED = ["eintragen", "einfügen", "eingeben", "ergänzen", " ici", " aquí", " here", " hier"]
PLACEHOLDERS = [
    (rf"\{{\{{\s*{_WORDS}\s*\}}\}}", ["{{"]),
    (rf"\{{%\s*{_WORDS}\s*%\}}", ["{%"]),
    (rf"<%=?\s*{_WORDS}\s*%>", ["<%"]),
    (rf"[#$]\{{\s*{_NAME}\s*\}}", ["#{", "${"]),
    (r"%%[\w\-]+%%", ["%%"]),
    (r"@@[\w\-]+@@", ["@@"]),
    (r"(?<!\w)__[A-Za-z][A-Za-z_]*?__(?!\w)", ["__"]),
    (rf"\[\[\s*{_WORDS}\s*\]\]", ["[["]),
    (rf"<<\s*{_WORDS}\s*>>", ["<<"]),
    (rf"«\s*{_WORDS}\s*»", ["«"]),
    (rf"[\[<(](?:{'|'.join(_OPENED)}) [\w\- ]+[\])>]", [left + word for left in "[<(" for word in _OPENED]),
    (rf"[\[<(][\w\- ]+(?:{'|'.join(_CLOSED)})[\])>]", [word + right for right in "])>" for word in _CLOSED]),
    (r"\b(?:insert|add|enter|type|write)(?: [\w\-]+){1,5} here\b", [" here"]),
    (r"\b(?:todo|fixme):? (?:add|write|insert|fill in|describe|explain) (?:the |a |an |your )?[\w\-]+", ["todo", "fixme"]),
    (r"\b(?:tbd|tba|todo) \([\w\- ]+\)", ["tbd (", "tba (", "todo ("]),
]
_NAMED = re.compile(r"^([ \t*#>\-]*(?:[^\W\d_]+:|dear|hello|hi)?[ \t]*)\[[^\W\d_][\w\- ]*\](?=[ \t.,]*$)", re.M)  # a line that is one name in brackets

COVERAGE = 0.95  # of a cell's weight, in windows that match
CONTAINED = 0.85  # of the weight of a whole cell, in the exemplars of one kind
PART = 0.9  # of the weight of a window that is a part of a text
# A term of no exemplar weighs most, so a window's share of exemplar terms bounds its containment from above: a cell
# with a smaller share than these can't match and isn't scored.
_KEEP, _KEEP_PART = min(CONTAINED, COVERAGE * PART), PART
_OWN_WORDS = 7  # terms of a window of filler in words of its own

_SLOT = re.compile("|".join(pattern for pattern, _ in PLACEHOLDERS), re.I)
_SLOT_SIGNS = tuple(dict.fromkeys(sign for _, signs in PLACEHOLDERS for sign in signs))
_BLANK = re.compile(r"\n[ \t]*\n")
_CODE = re.compile(r"\b[45]\d\d\b")
_PROGRAM = re.compile(r"\w\(|\w\)?\s*=\s*[\w(\[]|^\s*(?:import|from|def|return|raise)\b")
_ODD = re.compile(r'[^\w\s.,;:!?*>#|"\-]|[\d_]')
_TERM = re.compile(r"§|[^\W\d_]+")


_LETTERS_ONLY = {c: " " for c in range(128) if not chr(c).isalpha()}


def _words(lowered: str) -> list[str]:
    return lowered.translate(_LETTERS_ONLY).split() if lowered.isascii() else _TERM.findall(lowered)


def slot_signs(lowered: str) -> list[str]:
    """The signs in a text that a placeholder may begin or end with; without one it holds none."""
    return [sign for sign in _SLOT_SIGNS if sign in lowered]


def terms(text: str, signs: list[str] | None = None) -> list[str]:
    """Words in lower case, without numbers; an unfilled placeholder is one term, '§'."""
    text = text.lower()
    if not text.isascii():
        text = text.replace("§", " ")
    if any(sign in text for sign in (_SLOT_SIGNS if signs is None else signs)):
        text = _SLOT.sub(" § ", text)
    if "]" in text:
        text = _NAMED.sub(r"\1 § ", text)
    return _words(text)


def _forms(term: str) -> set[str]:
    """A word and its regular English inflections."""
    stem = term[:-1] if term.endswith("e") else term
    forms = {term, term + "s", stem + "ed", stem + "ing"}
    if len(term) > 4:
        forms |= {term.removesuffix("s"), term.removesuffix("ed"), term.removesuffix("d"), term.removesuffix("ing"), term.removesuffix("ing") + "e"}
    return forms if term.isascii() and len(term) > 2 else {term}


def _published() -> list[str]:
    """The error messages of Python's own HTTP modules."""
    page = re.sub(r"%\(\w+\)\w|<style.*?</style>|<!.*?>", " ", DEFAULT_ERROR_MESSAGE, flags=re.S)
    return [page, *(f"{status.phrase}. {status.description}" for status in HTTPStatus if status >= 400)]


@dataclass(frozen=True)
class Exemplar:
    text: str
    kind: str  # a key of MESSAGES, 'template' or 'filler'
    kernel: bool
    terms: Counter


class ExemplarIndex:
    """An inverted index of the exemplars; with document frequencies it scores windows of passages.

    A window is contained in a kind as far as its weight lies in the exemplars of that kind which it retrieves; and a
    message must also hold every term of one of the kind's kernels, short exemplars without which it says nothing.
    """

    def __init__(self, leave_out: frozenset[str] = frozenset()):
        texts = {kind: [*own, _COMMON] for kind, own in MESSAGES.items()} | {"template": TEMPLATES, "filler": [LOREM]}
        texts["error"] += [*MESSAGES["script"], *_published()]  # a notice of a server or viewer may speak of both
        texts["script"] += MESSAGES["error"]
        kernels = {**KERNELS, "error": [*KERNELS["error"], *(status.phrase for status in HTTPStatus if status >= 400)]}
        labelled = [(t, kind, False) for kind, own in texts.items() for t in own] + [(t, kind, True) for kind, own in kernels.items() for t in own]
        self.exemplars = [Exemplar(text, kind, kernel, Counter(_TERM.findall(text.lower()))) for text, kind, kernel in labelled if text not in leave_out]
        self.kinds = defaultdict(set)  # of each term
        self.postings = defaultdict(list)  # of kernels
        for i, e in enumerate(self.exemplars):
            for term in e.terms:
                for form in [term] if e.kind in ("template", "filler") else _forms(term):
                    self.kinds[form].add(e.kind)
                    if e.kernel:
                        self.postings[form].append((i, term))
        self.vocabulary = frozenset(self.kinds)
        self.longest = 2 * max(e.terms.total() for e in self.exemplars if e.kind != "filler")

    def weigh(self, documents: int, frequency: dict[str, int]) -> None:
        """Set the inverse document frequencies; a term of no exemplar weighs as much as the rarest."""
        self.idf = {t: math.log(1 + (documents + 1) / (1 + frequency.get(t, 0))) for t in self.vocabulary}
        self.unknown = math.log(2 + documents)

    def weight_of(self, own: Counter) -> float:
        return sum(n * self.idf.get(t, self.unknown) for t, n in own.items())

    def _has_kernel(self, own: Counter, kind: str, coded: bool) -> bool:
        found: dict[int, Counter] = defaultdict(Counter)
        for form in own:
            for i, term in self.postings.get(form, ()):
                e = self.exemplars[i]
                if e.kind == kind:
                    found[i][term] += own[form]
                    if e.terms <= found[i] and (own.total() > 1 or coded or e.text in ALONE):
                        return True
        return False

    def matches(self, own: Counter, plain: bool, coded: bool, needed: float = CONTAINED) -> bool:
        """Whether a window of passages is a whole leftover; ``plain``: it holds nothing but words, ``coded``: an HTTP error's number."""
        total = self.weight_of(own)
        if not total:
            return False
        if plain and own.total() >= _OWN_WORDS and not _SEEDS.isdisjoint(own) and _FUNCTION.isdisjoint(own):
            return True
        inside: dict[str, float] = defaultdict(float)
        for term, n in own.items():
            for kind in self.kinds.get(term, ()):
                inside[kind] += n * self.idf[term]
        for kind, weight in inside.items():
            if weight < needed * total:
                continue
            if kind == "template":
                if own["§"] and weight >= PART * total:
                    return True
            elif kind == "filler":
                if own.total() >= 2 and not _SEEDS.isdisjoint(own) and weight >= PART * total:
                    return True
            elif self._has_kernel(own, kind, coded):
                return True
        return False


def passages(body: str, by_line: bool) -> list[tuple[Counter, bool, bool, str]]:
    """The terms of each passage, whether it is plain, whether it is coded, and its text: of each line, or of each paragraph; those without terms are left out."""
    parts = body.split("\n") if by_line else _BLANK.split(body)
    return [(Counter(own), _ODD.search(part) is None, _CODE.search(part) is not None, part) for part in parts if (own := terms(part))]


def leftover_cell(index: ExemplarIndex, body: str, loose: bool) -> bool:
    """Whether a cell is a leftover: windows of its passages that match cover nearly all its weight.

    A window grows while it has no more terms than the longest exemplars have.  ``loose``: the text may hold several
    cells without marks between them, then one window that matches is enough.  Program text is none.
    """
    for by_line in (False, True):
        parts = passages(body, by_line)
        if not parts:
            return False
        own, plains, codes, texts = zip(*parts)
        if not loose and index.matches(sum(own, Counter()), all(plains), any(codes)):
            return True
        covered = [False] * len(parts)
        for at in range(len(parts)):
            window, plain, coded = Counter(), True, False
            for to in range(at, len(parts)):
                window.update(parts[to][0])
                plain, coded = plain and parts[to][1], coded or parts[to][2]
                if to > at and window.total() > index.longest:
                    break
                if index.matches(window, plain, coded, PART) and not _PROGRAM.search(" ".join(texts[at : to + 1])):
                    if loose:
                        return True
                    covered[at : to + 1] = [True] * (to + 1 - at)
        weights = [index.weight_of(p) for p in own]
        if any(covered) and sum(w for w, c in zip(weights, covered) if c) >= COVERAGE * sum(weights):
            return True
    return False


@cache
def _vocabulary() -> frozenset[str]:
    return ExemplarIndex().vocabulary


@lru_cache(1 << 16)
def _line_may_match(line: str) -> bool:
    own = terms(line)
    return bool(own) and (sum(map(_vocabulary().__contains__, own)) >= _KEEP_PART * len(own) or not _SEEDS.isdisjoint(own))


def candidate_cells(text: str) -> tuple[set[str], list[tuple[bool, str]]]:
    """(exemplar terms of the document, [(loose, text) of the cells worth scoring]).

    A placeholder in code is code: it counts as a term of the document only if it stands elsewhere.
    """
    vocabulary = _vocabulary()
    layout, cells = read_cells(text)
    lowered = ("\n".join(body for _, body in cells) if layout == "ipynb" else text).lower()
    own = set(vocabulary.intersection(_words(lowered)))
    own.discard("§")
    signs = slot_signs(lowered)
    if layout == "percent" and lowered.count("%%") == lowered.count("# %%"):
        signs = [sign for sign in signs if sign != "%%"]
    kept = []
    for kind, body in cells:
        loose = layout == "plain" or layout == "fence" and kind == MARKDOWN
        if kind == CODE and layout != "plain":
            continue
        if loose:
            keep = any(map(_line_may_match, body.split("\n")))
        else:
            found = terms(body, signs)
            keep = bool(found) and (sum(map(vocabulary.__contains__, found)) >= _KEEP * len(found) or not _SEEDS.isdisjoint(found))
        if keep:
            kept.append((loose, body))
            if "§" in terms(body, signs):
                own.add("§")
    return own, kept


_FIRST = "term STRING, n BIGINT, doc_id BIGINT, loose BOOLEAN, body STRING"
_ARROW = pa.schema([("term", pa.string()), ("n", pa.int64()), ("doc_id", pa.int64()), ("loose", pa.bool_()), ("body", pa.string())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a term: its document frequency in a part of the corpus ('' counts the documents); else a cell to score."""
    frequency: Counter = Counter()
    for batch in batches:
        ids, loose, bodies = [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if doc_id is None or text is None:
                continue
            own, kept = candidate_cells(text)
            frequency.update(own)
            frequency[""] += 1
            for part, body in kept:
                ids.append(doc_id)
                loose.append(part)
                bodies.append(body)
        n = len(ids)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(loose, pa.bool_()), pa.array(bodies, pa.string())], schema=_ARROW)
    n = len(frequency)
    yield pa.RecordBatch.from_arrays([pa.array(list(frequency), pa.string()), pa.array(list(frequency.values()), pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.string())], schema=_ARROW)


def leftover_documents(documents: DataFrame) -> DataFrame:
    """doc_id of the documents with a whole markdown or output cell, or the whole text, that is such a leftover.

    Null and empty texts are none.  Where the layout does not mark a cell's end, a run of lines or paragraphs
    counts as a cell.  Each doc_id comes once.
    """
    scanned = materialize(documents.select("doc_id", "text").mapInArrow(_scan, _FIRST), "residue-cells")
    counts = {r["term"]: r["n"] for r in scanned.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()}  # a row per exemplar term

    def score(batches):
        index = ExemplarIndex()
        index.weigh(counts.get("", 0), counts)
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())
            found = {doc_id for doc_id, loose, body in rows if leftover_cell(index, body, loose)}
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(sorted(found), pa.int64())})

    return scanned.where("term IS NULL").select("doc_id", "loose", "body").mapInArrow(score, "doc_id BIGINT").distinct()
