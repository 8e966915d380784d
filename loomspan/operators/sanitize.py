"""An allow-list sanitizer on the document tree, and what it takes away.

Elements that are not allowed go, their content stays, but for those whose
content is code. Attributes that are not allowed go, and so do addresses of
schemes that are not. Addresses are judged as browsers read them: entities are
decoded by the parser, blanks and control characters before and within the
scheme don't count. What a page would lose is its risk: handlers of events and
addresses that are scripts, on any element.
"""

from __future__ import annotations

import re
from html import escape

from .dom import VOID, Node

#: Elements and attributes that carry content, and schemes that only lead somewhere.
ELEMENTS = frozenset(
    "a abbr acronym area article aside b bdi bdo blockquote br caption center cite code col colgroup data dd del details dfn div dl dt em figcaption figure footer h1 h2 h3 h4 h5 h6 header hgroup hr i img ins kbd kbd li map mark nav "
    "ol p pre q rp rt rtc ruby s samp small span strike strong sub summary sup table tbody td th thead time tr tt u ul var wbr".split()
)
CODE = frozenset("script style template noscript iframe object embed".split())
ATTRIBUTES = frozenset("lang title".split())
OF_ELEMENT = {
    "a": "href hreflang", "bdo": "dir", "blockquote": "cite", "col": "align char charoff span", "colgroup": "align char charoff span", "del": "cite datetime", "hr": "align size width", "img": "align alt height src width", "ins": "cite datetime",
    "ol": "start", "q": "cite", "table": "align char charoff summary", "tbody": "align char charoff", "td": "align char charoff colspan headers rowspan", "tfoot": "align char charoff", "th": "align char charoff colspan headers rowspan scope", "thead": "align char charoff", "tr": "align char charoff",
}
ALLOWED = {tag: ATTRIBUTES | {*names.split()} for tag, names in OF_ELEMENT.items()}
ADDRESSES = frozenset("href src action formaction cite data poster background xlink:href srcset".split())
SCHEMES = frozenset("bitcoin ftp ftps geo http https im irc ircs magnet mailto mms mx news nntp openpgp4fpr sip sms smsto ssh tel url webcal wtai xmpp".split())
SCRIPTS = frozenset(("javascript", "vbscript"))
_IGNORED = re.compile("[\\x00-\\x20\\x7f-\\x9f\\u200b\\ufeff]+")


def scheme(address: str) -> str:
    """The scheme as browsers see it; empty for relative addresses."""
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", _IGNORED.sub("", address[:2000]))
    return m[1].lower() if m else ""


def _keeps(tag: str, name: str, value: str) -> bool:
    if name not in ALLOWED.get(tag, ATTRIBUTES):
        return False
    return name not in ADDRESSES or scheme(value) in ("", *SCHEMES)


def sanitized(n: Node) -> str:
    """Markup of what is allowed below an element."""
    out = []
    for c in n.children:
        if isinstance(c, str):
            out.append(escape(c, quote=False))
        elif c.tag in ELEMENTS:
            attrs = "".join(f' {k}="{escape(v)}"' for k, v in c.attrs.items() if _keeps(c.tag, k, v))
            out.append(f"<{c.tag}{attrs}>" + ("" if c.tag in VOID else f"{sanitized(c)}</{c.tag}>"))
        elif c.tag not in CODE:
            out.append(sanitized(c))
    return "".join(out)


def _risks(elements: list[Node], allowed: bool) -> tuple[int, int]:
    """Handlers and script addresses of elements, all of them or those that stay."""
    handlers = scripts = 0
    for n in elements:
        if allowed and n.tag not in ELEMENTS:
            continue
        for k, v in n.attrs.items():
            if not allowed or _keeps(n.tag, k, v):
                handlers += k.startswith("on") and len(k) > 2
                scripts += k in ADDRESSES and scheme(v) in SCRIPTS
    return handlers, scripts


def lost(doc: Node) -> tuple[int, int]:
    """How many handlers of events and script addresses the sanitizer takes from a page."""
    elements = list(doc.walk())
    before, after = _risks(elements, False), _risks(elements, True)
    return before[0] - after[0], before[1] - after[1]


#: Markup without any of these loses neither.
HINT = r"(?i)[\s/\"'](?:on[a-z]+)\s*=|&#|&tab;|&newline;|&colon;|s\s*c\s*r\s*i\s*p\s*t\s*:"
