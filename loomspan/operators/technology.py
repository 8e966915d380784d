"""Technologies of a page, from a fixed table of marks in its markup, headers, metas and script addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name, category, and what tells it: patterns of markup, parts of header values, parts of meta contents, patterns of script addresses.
TECHNOLOGIES = (
    ("WordPress", "CMS", ("wp-content", "wp-includes"), {"x-powered-by": "WordPress"}, {"generator": "WordPress"}, ("wp-includes/js",)),
    ("React", "JS Framework", ("data-reactroot", "data-reactid", "__REACT_DEVTOOLS"), {}, {}, (r"react\.production\.min\.js", "react-dom")),
    ("Vue.js", "JS Framework", ("data-v-", r"Vue\.js"), {}, {}, (r"vue\.runtime", r"vue\.global")),
    ("Angular", "JS Framework", ("ng-version", "ng-app", "_nghost"), {}, {}, ("angular", r"zone\.js")),
    ("Next.js", "Web Framework", ("__NEXT_DATA__", "_next/static"), {"x-powered-by": "Next.js"}, {}, ("_next/static",)),
    ("Nuxt.js", "Web Framework", ("__NUXT__", "_nuxt/"), {}, {}, ("_nuxt/",)),
    ("Svelte", "JS Framework", ("svelte-", "__svelte"), {}, {}, ()),
    ("jQuery", "JS Framework", (), {}, {}, ("jquery[.-]",)),
    ("Bootstrap", "CSS Framework", (r"bootstrap\.min\.css", r"bootstrap\.min\.js"), {}, {}, ("bootstrap",)),
    ("Tailwind CSS", "CSS Framework", ("tailwindcss", r"tailwind\.min\.css"), {}, {}, ()),
    ("Google Analytics", "Analytics", (r"google-analytics\.com/analytics", r"googletagmanager\.com/gtag"), {}, {}, ("google-analytics", "googletagmanager")),
    ("Google Tag Manager", "Analytics", (r"googletagmanager\.com/gtm",), {}, {}, (r"googletagmanager\.com/gtm",)),
    ("nginx", "Web Server", (), {"server": "nginx"}, {}, ()),
    ("Apache", "Web Server", (), {"server": "Apache"}, {}, ()),
    ("Cloudflare", "CDN", (), {"cf-ray": "", "server": "cloudflare"}, {}, ()),
    ("Vercel", "CDN", (), {"x-vercel-id": "", "server": "Vercel"}, {}, ()),
    ("Netlify", "CDN", (), {"x-nf-request-id": "", "server": "Netlify"}, {}, ()),
    ("PHP", "Programming Language", (), {"x-powered-by": "PHP"}, {}, ()),
    ("Express", "Web Framework", (), {"x-powered-by": "Express"}, {}, ()),
    ("Django", "Web Framework", ("csrfmiddlewaretoken", "django"), {"x-frame-options": "DENY"}, {}, ()),
    ("Ruby on Rails", "Web Framework", (), {"x-request-id": "", "x-runtime": ""}, {"csrf-param": "authenticity_token"}, ()),
    ("Shopify", "CMS", (r"cdn\.shopify\.com", r"Shopify\.theme"), {"x-shopid": ""}, {}, (r"cdn\.shopify\.com",)),
    ("Wix", "CMS", (r"wix\.com", "_wixCIDX"), {}, {}, (r"static\.parastorage\.com",)),
    ("Gatsby", "Web Framework", ("___gatsby", "gatsby-"), {}, {"generator": "Gatsby"}, ()),
    ("Remix", "Web Framework", ("__remixContext",), {}, {}, ()),
    ("Material UI", "CSS Framework", ("MuiButton", "MuiPaper", "MuiTypography"), {}, {}, ()),
    ("Font Awesome", "CSS Framework", ("font-awesome", "fontawesome"), {}, {}, ("fontawesome",)),
    ("Hotjar", "Analytics", (), {}, {}, (r"static\.hotjar\.com",)),
    ("Stripe", "Analytics", (), {}, {}, (r"js\.stripe\.com",)),
    ("Sentry", "Analytics", (), {}, {}, (r"browser\.sentry-cdn\.com", r"sentry\.io")),
)
MARKUP, HEADER, META, SCRIPT = 50, 50, 25, 25


def _any(found: list[Column]) -> Column:
    out = F.lit(False)
    for f in found:
        out = out | F.coalesce(f, F.lit(False))
    return out


def _exists(texts: Column, pattern: str) -> Column:
    return F.exists(texts, lambda t: t.rlike(pattern))


def _points(found: Column, n: int) -> Column:
    return F.when(found, F.lit(n)).otherwise(F.lit(0))


def technologies(html: Column, headers: Column) -> Column:
    """Array of (name, category, confidence), the most certain first, then in the order of the table.

    Each kind of mark counts once. Where markup, headers or metas have told
    already, only the first pattern of script addresses is tried.
    """
    scripts = F.regexp_extract_all(html, F.lit(r"""(?is)<script\b[^>]*\ssrc\s*=\s*["']([^"']*)["']"""), F.lit(1))
    metas = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0)), lambda t: F.lower(t))
    content = lambda t: F.regexp_extract(t, r"""\scontent\s*=\s*["']([^"']*)["']""", 1)

    def header(name: str, part: str) -> Column:
        value = F.lower(F.try_element_at(headers, F.lit(name)))
        return F.contains(value, F.lit(part.lower())) if part else value.isNotNull()

    def meta(name: str, part: str) -> Column:
        return F.exists(metas, lambda t: t.rlike(rf"""\sname\s*=\s*["']?{name}["'\s]""") & F.contains(content(t), F.lit(part.lower())))

    def one(place: int, name: str, category: str, marks, heads, words, sources) -> Column:
        told = _points(_any([html.rlike(f"(?i){p}") for p in marks]), MARKUP) + _points(_any([header(k, v) for k, v in heads.items()]), HEADER) + _points(_any([meta(k, v) for k, v in words.items()]), META)
        by_script = [_exists(scripts, f"(?i){p}") for p in sources]
        if by_script:
            told = told + F.when(told > 0, _points(by_script[0], SCRIPT)).otherwise(_points(_any(by_script), SCRIPT))
        sure = F.least(told, F.lit(100))
        return F.when(sure > 0, F.struct((-sure).alias("order"), F.lit(place).alias("place"), F.lit(name).alias("name"), F.lit(category).alias("category"), sure.alias("confidence")))

    found = F.array_sort(F.array_compact(F.array(*(one(i, *t) for i, t in enumerate(TECHNOLOGIES)))))
    return F.transform(found, lambda t: F.struct(t["name"].alias("name"), t["category"].alias("category"), t["confidence"].alias("confidence")))


def detect(responses: DataFrame) -> DataFrame:
    """page_id, name, category, confidence of each technology of ``responses`` (page_id, html, headers)."""
    return responses.select("page_id", F.inline(technologies(F.col("html"), F.col("headers"))))
