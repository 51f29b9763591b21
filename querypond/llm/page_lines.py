"""Lines of markdown and HTML pages with what can be told from a single page: text, role, links, containers and wording."""

from __future__ import annotations

import html as html_entities
import re
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate
from re import _constants as sre
from re import _parser as sre_parser

#: Wording of page furniture in English, German, French and Spanish. Phrases by what they ask or say.
_WORDING = [
            # consent
            r"\b(we|this site|our site|this page)\b.{0,30}\b(use|uses|set|sets|store|stores)\b.{0,20}\bcookies?\b", r"\bcookies?\b.{0,60}\b(accept|preferences|consent|zustimm|einwillig)", r"\bpartners? (store|process)\b", r"\byour privacy\b", r"\boptional trackers\b",
            r"\bwir (setzen|verwenden|nutzen)\b.{0,20}\bcookies", r"\bdiese (seite|website)\b.{0,30}\bspeichert\b", r"\bdatenschutzerklärung\b", r"\bce site\b.{0,30}\bcookies", r"\bpolitique de confidentialité", r"\busamos cookies", r"\beste sitio\b.{0,20}\bcookies", r"\bpolítica de privacidad",
            # ends of pages
            r"©|\bcopyright\b|\(c\) \d{4}", r"\ball rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos", r"\bregistered trademark\b", r"^\W*(made|built|powered) by (the )?\S+", r"^(terms|imprint|impressum|mentions légales|aviso legal|plan du site|sitemap)\b", r"\b(sitemap|accessibility|imprint|datenschutz|agb)\s*([|·]|$)",
            # sharing, subscription, comments, feedback
            r"^\W*(share|tweet|teilen|partager|compartir|pin|mail|print|drucken|imprimer|imprimir|save|merken)(\W+(share|tweet|teilen|partager|compartir|pin|mail|print|drucken|imprimer|imprimir|save|merken|this page|on \w+))*\W*$", r"^\W*(share|print|save) this (page|article|post)", r"^\d[\d.,]* (shares|comments?|kommentare?|commentaires?|comentarios?|likes|geteilt|partages)\W*$",
            r"\b(newsletter|boletín|lettre de)\b.{0,60}\b(bestellen|anmelden|abonnieren|semaine|semana|week|inbox)", r"\bsign up for\b", r"\bsubscribe (to|for|now|today)\b.{0,40}(our|newsletter|updates|$)", r"\bin your inbox\b", r"^(join|rejoignez|schon|únete)\b.{0,30}\d.{0,40}\b(readers?|abonnés|lesen|lectores|subscribers)\b", r"^(follow|folge|suivez|sigue a)\b.{0,60}$",
            r"^(recevez|recibe|jetzt den|get the best of)\b", r"\bcreate a free account\b|\bsign in to (save|comment|reply)|\blog in to (reply|comment)", r"^zum antworten anmelden|^connectez-vous pour|^inicia sesión para", r"^loading comments|^(post|leave|add) a (comment|reply)", r"\bto (view|see|load) the comments?\b", r"\bwas this (page|article) helpful|cette page vous a-t-elle", r"^war diese seite hilfreich|^¿?te (ha )?(resultado|sido) útil|^rate this",
            r"^(edit|improve) this page|^skip to (main )?content|^zum inhalt springen|^aller au contenu|^saltar al contenido|^back to top|^nach oben|^(continue|keep) reading( below)?\W*$|^weiterlesen\W*$|^lire la suite\W*$",
            # advertising and related items
            r"^(advertisement|anzeige|publicité|publicidad|werbung|sponsored|promoted)\b", r"^(contenu (sponsorisé|partenaire)|contenido patrocinado|gesponsert|patrocinado|ofrecido|presentado|sponsorisé|offert|présenté|präsentiert|unterstützt|brought to you|presented|powered|in partnership)( von| by| par| por| with)?\b.{0,60}$", r"^hire \S+.{0,40}\b(engineers|developers|experts)\b", r"\btry it free\b",
            r"^(trending|related( articles| posts)?|you may also like|popular( this week| posts)?|more from|recommended|most read|read next|see also from|das könnte dich auch interessieren|meistgelesen|mehr von|à lire aussi|les plus lus|plus sur|te puede interesar|lo más leído|más de)\b.{0,40}$",
            r"^(trending|related( articles| posts)?|you may also like|popular( this week| posts)?|more from [^:]{1,40}|recommended|most read|das könnte dich auch interessieren|meistgelesen|mehr von [^:]{1,40}|à lire aussi|les plus lus|plus sur [^:]{1,40}|te puede interesar|lo más leído|más de [^:]{1,40})\s*: ",
]
_ANCHORED = re.compile("|".join(p for p in _WORDING if p.startswith("^")), re.I)
_FREE = re.compile("|".join(p for p in _WORDING if not p.startswith("^")), re.I)


def _literals(parsed) -> set[str]:
    """Texts of which every match of a parsed pattern holds one; of its parts the one whose shortest text is longest."""
    options, run = [], ""
    for op, arg in [*parsed, (None, None)]:
        if op is sre.LITERAL:
            run += chr(arg).lower()
            continue
        if run:
            options.append({run})
        run = ""
        if op is sre.BRANCH:
            options.append(set().union(*map(_literals, arg[1])))
        elif op is sre.SUBPATTERN:
            options.append(_literals(arg[3]))
        elif op is sre.MAX_REPEAT and arg[0] > 0:
            options.append(_literals(arg[2]))
    return max(options, key=lambda o: min(map(len, o), default=0), default={""})


def _by_trigger(patterns: list[str]) -> dict[str, re.Pattern]:
    """Of texts, in lower case, that every match of some patterns holds one of: the patterns it may belong to. Made from the patterns."""
    found: dict[str, list[str]] = {}
    for p in patterns:
        for trigger in _literals(sre_parser.parse(p)):
            found.setdefault(trigger, []).append(p)
    return {t: re.compile("|".join(found[t]), re.I) for t in sorted(found)}


_TRIGGERS = _by_trigger([p for p in _WORDING if not p.startswith("^")])


#: Words that name sections of sites. Fixed values.
SECTIONS = frozenset(
    "home about pricing jobs careers tutorials api blog contact support login register signup changelog community docs documentation forum guides help faq status terms privacy start über anmelden anleitungen "
    "neuigkeiten preise hilfe kontakt startseite accueil aide tarifs connexion équipe nouveautés inicio precios contacto entrar novedades equipo guías foro ayuda".split()
)
RELATED = re.compile(r"^(trending|related|you may also like|popular|more from|recommended|most read|read next|das könnte|meistgelesen|mehr von|à lire aussi|les plus lus|plus sur|te puede interesar|lo más leído|más de)\b", re.I)
MARKDOWN_LINK = re.compile(r"!?\[([^\]]*)\]\(([^)\s]*)[^)]*\)")
TAG = re.compile(r"<!--.*?-->|<(/?)([a-zA-Z][a-zA-Z0-9]*)\b([^<>]*)>", re.S)
WORD = re.compile(r"\w+")
FENCE = re.compile(r"^\s*(```+|~~~+)")


@dataclass
class Line:
    number: int
    text: str
    role: str = "p"  # h1, h, li, p, code
    inside: int = 0  # links to the site itself
    outside: int = 0
    linked: int = 0  # words inside links
    block: int = 0  # number of the run of lines that it stands in
    side: bool = False  # in a navigation, aside, footer or menu container
    depth: int = 0
    words: list[str] = field(default_factory=list)
    wording: int = -1  # where furniture's wording begins, -1 for none


def find_wording(lines: list[Line]) -> None:
    """Sets where furniture's wording begins in each line. Every line is searched whole; the triggers are looked up a page at a time."""
    low = [line.text.lower() for line in lines]
    ends = list(accumulate(len(x) + 1 for x in low))
    page, found = "\n".join(low), {}
    for trigger, patterns in _TRIGGERS.items():
        at = page.find(trigger)
        while at >= 0:
            i = bisect_right(ends, at)
            if m := patterns.search(lines[i].text):
                found[i] = min(m.start(), found.get(i, m.start()))
            at = page.find(trigger, ends[i])
    for i, line in enumerate(lines):
        line.wording = 0 if _ANCHORED.match(line.text) else found.get(i, -1)


_HREF = re.compile(r"href\s*=\s*[\"']?([^\"'\s>]*)")
_HIDING = re.compile(r"<(script|style)\b[^<>]*>", re.I)
_SPACE = re.compile(r"\s+")
_ABSOLUTE = re.compile(r"https?://")
_VISIBLE = re.compile(r"[^\W_]")
_HEADING = re.compile(r"\s*(#{1,6})\s+(.*)")
_ITEM = re.compile(r"\s*(?:[-*+]|\d+[.)])\s+(.*)")
_ANY_TAG = re.compile(r"<[^<>]*>")
_CRUMB = re.compile(r"\s[»›>/]\s")
_DIGIT = re.compile(r"\d")
_NUMBERED = re.compile(r"\b[^\W\d]*\d\w*")


def _links(line: Line, pairs: list[tuple[str, str]]) -> None:
    for label, target in pairs:
        if _ABSOLUTE.match(target):
            line.outside += 1
        else:
            line.inside += 1
        line.linked += len(WORD.findall(label))


def markdown_lines(text: str) -> list[Line]:
    """The lines with visible text, numbered from 1 as line feeds divide them."""
    out, fence, block, blank = [], None, 0, True
    for number, raw in enumerate(text.split("\n"), 1):
        bare = raw.strip()
        start = bare[:1]
        mark = FENCE.match(raw) if start in ("`", "~") and start else None
        if fence:
            if mark and mark[1].startswith(fence):
                fence = None
                block += 1
            elif _VISIBLE.search(bare):
                out.append(Line(number, bare, "code", block=block, words=WORD.findall(bare.lower())))
            continue
        if mark:
            fence = mark[1][:3]
            block += 1
            continue
        if not bare:
            blank = True
            continue
        line = Line(number, bare)
        if start == "#" and (m := _HEADING.match(raw)):
            line.role, line.text = ("h1" if len(m[1]) == 1 else "h"), m[2]
        elif (start in "-*+" or start.isdigit()) and (m := _ITEM.match(raw)):
            line.role, line.text = "li", m[1]
        elif raw.startswith(("    ", "\t")) and (blank or out and out[-1].role == "code" and out[-1].number == number - 1):
            line.role = "code"
        elif start == ">":
            line.text = bare.lstrip(" >")
        if blank or not out or (out[-1].role == "li") != (line.role == "li") or line.role in ("h1", "h"):
            block += 1
        blank = False
        if line.role != "code":
            if "](" in line.text:
                _links(line, MARKDOWN_LINK.findall(line.text))
                line.text = MARKDOWN_LINK.sub(r"\1", line.text)
            if "<" in line.text:
                line.text = _ANY_TAG.sub(" ", line.text)
        line.words = WORD.findall(line.text.lower())
        line.block = block
        if line.words and _VISIBLE.search(line.text):
            out.append(line)
    return out


def html_lines(text: str) -> list[Line]:
    """The same for HTML; containers are followed over the lines."""
    out, stack, block, hidden, pre = [], [], 0, None, 0
    href = None
    for number, raw in enumerate(text.split("\n"), 1):
        line = Line(number, "")
        pieces, at, links, label = [], 0, [], []
        if hidden:
            end = re.search(rf"</{hidden}\s*>|-->", raw, re.I) if hidden != "!--" else re.search("-->", raw)
            if not end:
                continue
            raw, hidden = raw[end.end() :], None
        if _HIDING.search(raw):
            raw = re.sub(r"<(script|style)\b[^<>]*>.*?</\1\s*>", " ", raw, flags=re.I | re.S)
            if m := _HIDING.search(raw):
                raw, hidden = raw[: m.start()], m[1].lower()
        if "<!--" in raw and "-->" not in raw[raw.rindex("<!--") :]:
            raw, hidden = raw[: raw.rindex("<!--")], "!--"
        role = "code" if pre else "p"
        side = any(s for _, s in stack)
        for m in TAG.finditer(raw):
            if seen := raw[at : m.start()]:
                pieces.append(seen)
                if href is not None:
                    label.append(seen)
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            closing = bool(m[1])
            if name in ("h1", "h2", "h3", "h4", "h5", "h6") and not closing:
                role, block = ("h1" if name == "h1" else "h"), block + 1
            elif name == "li" and not closing:
                role = "li"
            elif name == "a":
                if closing and href is not None:
                    links.append((" ".join(label), href))
                    href, label = None, []
                elif not closing:
                    found = _HREF.search(m[3])
                    href, label = (found[1] if found else "#"), []
            elif name == "pre":
                pre = max(0, pre + (-1 if closing else 1))
                role = "code"
                block += 1
            elif name in ("div", "section", "article", "main", "aside", "nav", "footer", "header", "ul", "ol", "body"):
                if closing:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == name:
                            del stack[k:]
                            break
                else:
                    marked = "=" in m[3] and re.search(r"(?:class|id|role)\s*=\s*[\"']?[^\"'>]*\b(menu|nav\w*|sidebar|widget|footer|share|social|promo|ads?|related|cookie|banner|breadcrumbs?|comments?)\b", m[3], re.I)
                    stack.append((name, name in ("aside", "nav", "footer") or bool(marked)))
                    side = side or stack[-1][1]
                block += 1
            if name in ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "table"):
                pieces.append(" ")
        pieces.append(raw[at:])
        if href is not None:
            label.append(raw[at:])
            links.append((" ".join(label), href))
            label = []
        line.text = " ".join(html_entities.unescape("".join(pieces)).split())
        if not raw.strip():
            block += 1
            continue
        if not _VISIBLE.search(line.text):
            continue
        _links(line, links)
        line.role, line.side, line.depth, line.block, line.words = role, side, len(stack), block, WORD.findall(line.text.lower())
        out.append(line)
    return out


def site_name(host: str | None) -> str:
    parts = (host or "").lower().split(".")
    return parts[-2] if len(parts) > 1 else (parts[0] if parts else "")


def masked(text: str, site: str) -> str:
    """A line without what differs from page to page: the site's name, tokens with digits, case, spacing."""
    out = text.lower()
    words = out.split()
    if _DIGIT.search(out):
        words = [_NUMBERED.sub("0", w) if _DIGIT.search(w) else w for w in words]
    out = " ".join(words)
    return out.replace(site, "∅") if len(site) > 3 else out


def is_navigation(line: Line) -> bool:
    """Names of sections, or links to the site itself and nothing else."""
    if line.role == "code" or not line.words:
        return False
    words = line.words
    if SECTIONS.issuperset(words):
        return True
    if line.inside == 0 or line.outside or line.role in ("h1", "h"):
        return False
    return line.linked >= 0.6 * len(words) or bool(_CRUMB.search(line.text)) and len(words) <= 16


def is_furniture(line: Line) -> bool:
    """Furniture by its wording (find_wording) and links alone; long sentences that only mention such things are not."""
    if line.role in ("code", "h1"):
        return False
    if is_navigation(line):
        return True
    return line.wording == 0 or line.wording > 0 and len(line.words) <= 16
