"""Trusted signs of residue: unfilled placeholders, filler, and the few wordings and headings from which labels spread."""

from __future__ import annotations

import re

from querypond.llm.page_lines import Line

#: Names that Python gives to special methods; other words between double underscores are placeholders.
SPECIAL_METHODS = frozenset("init call new del repr str bytes format lt le eq ne gt ge hash bool getattr setattr delattr dir get set len iter next contains getitem setitem delitem enter exit aenter aexit await aiter anext add sub mul matmul name main file doc dict class slots all version author module qualname annotations post pre".split())
PLACEHOLDER = re.compile(
    r"(?=[{<$#%@_\[])(?:\{\{\{?[^{}\n]{0,80}\}\}\}?|\{%[^%\n]{0,80}%?\}|<%[^%\n]{0,80}%>|\$\{[^{}\n]{1,80}\}|#\{[^{}\n]{1,80}\}|\[\[[A-Za-z_][^\[\]\n|]{0,60}\]\]|%%[A-Za-z_][\w ]{0,60}%%|%\([A-Za-z_]\w{0,40}\)[sdif]|@@[A-Za-z_]\w{0,60}@@"
    r"|\$[A-Z][A-Z0-9_]{2,60}\$|(?<![\w{])\{(?:[a-z]+[A-Z]\w*|[a-z]+_\w+|\d+|[A-Z][A-Z0-9_]+|name|title|content|body|url|date|author|text|value|user|email)\}(?![\w}])|<(?:INSERT|YOUR|ENTER|ADD)[A-Z _-]{0,60}>|\[(?:INSERT|ENTER|ADD|YOUR|Insert|Enter|Your|Add)\b[^\[\]\n]{0,60}\](?!\()|__[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)*__)"
)
LOREM = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split())

#: Wordings that say for certain that a line stands in place of content; everything else is found from these and from error headings.
TRUSTED = re.compile(
    r"^\W*(?:"
    + "|".join(
        [
            r"(?:http |error )?[45]\d\d\W+(?:bad gateway|not found|forbidden|unauthori[sz]ed|internal server error|service unavailable|gateway time-?out)\W*$", r"the page you requested (?:could not be|was not) found\b.*", r"access (?:is |was )?denied\b.*", r"(?:zugriff verweigert|accès refusé|acceso denegado)\W*$", r"internal server error\b.*", r"uncaught exception\b.*", r"i(?:'m| am) sorry,? but i (?:can't|cannot)\b.*", r"as an ai\b.*",
            # scripts are needed
            r"(?:you (?:need|have) to|please|this (?:site|page|app|application)|your browser|javascript|scripts|loading)\b.*\b(?:javascript|scripts|enable|allow|required|disabled|switched off)\b.*", r"(?:bitte|diese (?:seite|anwendung))\b.*\b(?:javascript|skripten?)\b.*", r"(?:cette (?:page|application)|veuillez)\b.*\b(?:javascript|scripts)\b.*", r"(?:activa|habilita|esta (?:página|aplicación))\b.*\b(?:javascript|scripts)\b.*",
            # filler
            r"(?:todo|tbd|fixme)\b\W.*", r"(?:placeholder|dummy|sample|filler) (?:copy|text|content)\b.*", r"your (?:text|content|title) (?:goes )?here\W*$", r"(?:coming soon|under construction|hello,? world)\W*$", r"(?:hier (?:steht|kommt|folgt) (?:später )?(?:der|ihr|dein)\b.*\b(?:inhalt|text)|blindtext|beispieltext)\W*$", r"(?:texte|contenu) (?:à venir|d'exemple|de remplacement)\W*$", r"texto de (?:ejemplo|relleno|prueba)\W*$",
        ]
    )
    + ")",
    re.I,
)
#: Words above which a wording only mentions such a thing.
MESSAGE_WORDS = 40
ERROR_HEADING = re.compile(r"^\W*(?:(?:error|oops|whoops)(?:\W+[45]\d\d)?|[45]\d\d(?:\W+(?:error|not found|bad gateway|forbidden|unauthori[sz]ed|service unavailable|internal server error|gateway time-?out|too many requests))?)\W*$", re.I)
TRACE = re.compile(r"^(?:at \S+ ?\(\S+:\d+(?::\d+)?\)|at \S+:\d+(?::\d+)?|File \"[^\"]+\", line \d+.*|Traceback \(most recent call last\):|#\d+ \S+\(\d+\): .*|goroutine \d+ .*)$")


def without_code(text: str) -> str:
    out, fence = [], None
    for raw in text.split("\n"):
        mark = re.match(r"\s*(```+|~~~+)", raw)
        if fence:
            if mark and mark[1].startswith(fence):
                fence = None
        elif mark:
            fence = mark[1][:3]
        else:
            out.append(raw)
    return re.sub(r"(`+)[^`]+?\1", " ", "\n".join(out))


def has_placeholder(text: str) -> bool:
    if not PLACEHOLDER.search(text):  # hardly any page needs the look at its code
        return False
    for m in PLACEHOLDER.finditer(without_code(text)):
        word = m[0]
        if word.startswith("__") and word.strip("_").lower() in SPECIAL_METHODS:
            continue
        return True
    return False


def is_error_heading(text: str) -> bool:
    return bool(ERROR_HEADING.match(text))


def is_trace(line: Line) -> bool:
    """A frame of a stack trace: code, but no content."""
    return line.role == "code" and bool(TRACE.match(line.text.strip()))


def is_stray(line: Line) -> bool:
    """A line that belongs to neither: references of errors."""
    return len(line.words) <= 6 and line.words[0] in ("ref", "reference", "request", "ray", "incident", "code", "id")


def is_filler(line: Line) -> bool:
    """Filler text by its vocabulary."""
    return line.role != "code" and len(line.words) >= 3 and sum(w in LOREM for w in line.words) >= 0.6 * len(line.words)


def says_residue(line: Line) -> bool:
    return line.role != "code" and len(line.words) <= MESSAGE_WORDS and bool(TRUSTED.match(line.text))
