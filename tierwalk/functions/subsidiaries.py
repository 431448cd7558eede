"""Lists of subsidiaries: tables in markup, columns in plain text, and where a filing's list is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierwalk.functions.filing_text import plain, unescaped, without_tags
from tierwalk.functions.text import let, one_spaced

# What heads a list, what is noise in it, document types of lists, and codes of states.
HEADERS = (r"name\s+of\s+subsidiar", r"subsidiar(?:y|ies)\s+(?:name|list)", r"jurisdiction\s+of\s+(?:organization|incorporation)", r"state\s+or\s+(?:other\s+)?jurisdiction")
NOISE = (r"^\s*(?:page|continued|see\s+note|exhibit\s+21)", r"^\s*\d+\s*$", r"^\s*[-=_]{5,}\s*$")
TYPES = ("EX-21", "EX-21.1", "EX-21.01")
STATES = {
    "DE": "Delaware", "VA": "Virginia", "NC": "North Carolina", "NY": "New York", "CA": "California", "TX": "Texas", "PA": "Pennsylvania", "OH": "Ohio", "IL": "Illinois", "GA": "Georgia", "MD": "Maryland",
    "NJ": "New Jersey", "FL": "Florida", "MA": "Massachusetts", "CT": "Connecticut", "WI": "Wisconsin", "MN": "Minnesota", "MO": "Missouri", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "OK": "Oklahoma",
    "CO": "Colorado", "OR": "Oregon", "WA": "Washington", "NV": "Nevada", "WY": "Wyoming", "SD": "South Dakota", "ND": "North Dakota", "SC": "South Carolina", "TN": "Tennessee", "KY": "Kentucky",
    "LA": "Louisiana", "AR": "Arkansas", "MS": "Mississippi", "AL": "Alabama", "NE": "Nebraska", "UT": "Utah", "AZ": "Arizona", "NM": "New Mexico", "HI": "Hawaii", "AK": "Alaska", "ME": "Maine",
    "NH": "New Hampshire", "VT": "Vermont", "RI": "Rhode Island", "MT": "Montana", "ID": "Idaho", "WV": "West Virginia", "DC": "District of Columbia",
}
LINE = r"^(.{5,80}?)\s{3,}(.{3,50}?)(?:\s{3,}(.+?))?$"


def is_header(c: Column) -> Column:
    return c.rlike("(?i)" + "|".join(HEADERS))


def is_noise(c: Column) -> Column:
    return c.rlike("(?i)" + "|".join(NOISE))


def share(c: Column) -> Column:
    """A percentage in (0, 100]: wholly owned and 100% first, else the first number before %, if it is one."""
    number = F.regexp_extract(c, r"(\d{1,3}(?:\.\d+)?)\s*%", 1).try_cast("double")
    low = F.lower(c)
    return F.when(F.contains(low, F.lit("wholly")) & F.contains(low, F.lit("owned")), 100.0).when(F.contains(c, F.lit("100%")) | F.contains(c, F.lit("100 %")), 100.0).when((number > 0) & (number <= 100), number)


def clean_subsidiary(c: Column) -> Column:
    """Without bullets before it and notes or asterisks after it."""
    n = F.regexp_replace(c, r"^[\s\-\*•–—●○]+", "")
    n = F.regexp_replace(n, r"\s*[\(\[][0-9a-z]+[\)\]]\s*$", "")
    return one_spaced(F.regexp_replace(n, r"\s*\*+\s*$", ""))


def jurisdiction_name(c: Column) -> Column:
    """A state's code as its name; anything else with single blanks and without signs at the end."""
    j = one_spaced(F.regexp_replace(F.btrim(c), r"[.,;:]+$", ""))
    names = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.upper(j)), j)


def table_rows(markup: Column) -> Column:
    """Cells with text of every row of every table, in order; rows of a table inside another come once for each. Python's own parser builds the tree."""

    @F.pandas_udf("array<array<string>>")
    def run(s):
        from html.parser import HTMLParser

        single = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}

        class Tree(HTMLParser):
            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.root = ("", [])
                self.open = [self.root]

            def handle_starttag(self, tag, attrs):
                node = (tag, [])
                self.open[-1][1].append(node)
                if tag not in single:
                    self.open.append(node)

            def handle_endtag(self, tag):
                for i in range(len(self.open) - 1, 0, -1):
                    if self.open[i][0] == tag:
                        del self.open[i:]
                        break

            def handle_data(self, data):
                self.open[-1][1].append(data)

        def below(node, tag):
            # without recursion, so that deep markup is no danger
            stack = [iter(node[1])]
            while stack:
                for x in stack[-1]:
                    if isinstance(x, tuple):
                        if x[0] == tag:
                            yield x
                        stack.append(iter(x[1]))
                        break
                else:
                    stack.pop()

        def words(node):
            out, stack = [], [iter(node[1])]
            while stack:
                for x in stack[-1]:
                    if isinstance(x, tuple):
                        if x[0] not in ("script", "style"):
                            stack.append(iter(x[1]))
                            break
                    elif x.strip():
                        out.append(x.strip())
                else:
                    stack.pop()
            return "".join(out)

        def rows(t):
            tree = Tree()
            tree.feed(t)
            tree.close()
            return [[c for c in (words(td) for td in below(tr, "td")) if c] for table in below(tree.root, "table") for tr in below(table, "tr")]

        return s.map(lambda t: rows(t) if t else [])

    return run(markup)


def _entry(name: Column, place: Column, percent: Column, raw: Column) -> Column:
    return F.struct(clean_subsidiary(name).alias("name"), jurisdiction_name(place).alias("jurisdiction"), percent.alias("ownership_pct"), raw.alias("raw_text"))


def _after_header(rows: Column, heads, opens) -> Column:
    """Rows from the first that heads or opens the data on, without those that head."""
    cut = lambda rs, first: F.when(first > 0, F.filter(rs, lambda r, i: (i + 1 >= first) & ~heads(r))).otherwise(F.slice(rs, 1, 0))
    return let(rows, lambda rs: let(F.array_position(F.transform(rs, lambda r: heads(r) | opens(r)), F.lit(True)), lambda first: cut(rs, first)))


def _from_tables(rows: Column) -> Column:
    filled = F.filter(rows, lambda r: F.size(r) > 0)
    data = _after_header(filled, lambda r: is_header(F.lower(F.array_join(r, " "))), lambda r: F.size(r) >= 2)
    data = F.filter(data, lambda r: ~is_noise(F.get(r, F.lit(0))))
    cell = lambda r, i: F.get(r, F.lit(i))

    def several(r):
        return _entry(cell(r, 0), cell(r, 1), F.coalesce(share(F.coalesce(cell(r, 2), F.lit(""))), share(F.concat_ws(" ", cell(r, 0), cell(r, 1)))), F.array_join(r, " | "))

    def alone(r):
        parts = [F.filter(F.transform(F.split(cell(r, 0), sep), F.btrim), lambda p: p != "") for sep in ("\t", "   ", " - ", "  ")]
        cut = F.coalesce(*[F.when(F.size(p) >= 2, p) for p in parts])
        return F.when(cut.isNotNull(), _entry(F.get(cut, F.lit(0)), F.element_at(cut, -1), share(cell(r, 0)), cell(r, 0)))

    made = F.transform(data, lambda r: F.struct(F.size(r).alias("n"), F.when(F.size(r) >= 2, several(r)).otherwise(alone(r)).alias("e")))
    return F.transform(F.filter(made, lambda x: x["e"].isNotNull() & (F.length(x["e"]["name"]) >= 3) & ((x["n"] == 1) | (x["e"]["jurisdiction"] != ""))), lambda x: x["e"])


def _from_lines(text: Column) -> Column:
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.regexp_replace(x, r"\s+$", ""))
    lines = F.filter(lines, lambda x: (F.btrim(x) != "") & ~is_noise(F.btrim(x)))
    data = F.filter(_after_header(lines, is_header, lambda x: F.lit(False)), lambda x: x.rlike(LINE))
    part = lambda x, i: F.regexp_extract(x, LINE, i)
    made = F.transform(data, lambda x: _entry(part(x, 1), part(x, 2), F.coalesce(share(part(x, 3)), share(x)), F.btrim(x)))
    return F.filter(made, lambda e: (F.length(e["name"]) >= 3) & (e["jurisdiction"] != ""))


def subsidiaries(exhibits: DataFrame, content: str = "content", raw_lines: bool = True) -> DataFrame:
    """A row for each subsidiary listed: ord, name, jurisdiction, ownership_pct, raw_text.

    Tables count first; without any, lines of the content as it is (raw_lines; it keeps columns); then lines of its plain text.
    """
    rows = exhibits.withColumn("_tables", _from_tables(table_rows(F.col(content))))
    filled = lambda c: F.when(F.size(c) > 0, c)
    choices = [filled(F.col("_tables"))] + ([filled(_from_lines(F.col(content)))] if raw_lines else []) + [_from_lines(plain(unescaped(without_tags(F.col(content)))))]
    return rows.select(*exhibits.columns, F.posexplode(F.coalesce(*choices)).alias("ord", "_e")).select(*[c for c in exhibits.columns if c != content], "ord", "_e.*")


def list_address(index_pages: DataFrame, markup: str = "html", base: str = "") -> DataFrame:
    """index_pages with list_url: the address of the subsidiaries' list among a filing's documents; null without one.

    A row of four cells or more whose fourth is a list's type, else one whose second names such a type; the viewer's prefix is left out.
    """

    @F.pandas_udf("string")
    def find(s):
        import re

        row, cell, tag, link = re.compile(r"(?is)<tr\b.*?</tr>"), re.compile(r"(?is)<td\b[^>]*>(.*?)</td>"), re.compile(r"<[^>]+>"), re.compile(r"""(?is)<a\b[^>]*?href\s*=\s*["']?([^"'\s>]+)""")

        def one(page):
            rows = [cell.findall(r) for r in row.findall(page or "")]
            text = lambda c: tag.sub("", c).strip().upper()
            for fits in (lambda c: len(c) >= 4 and text(c[3]) in TYPES, lambda c: len(c) >= 3 and any(t in text(c[1]) for t in TYPES)):
                for c in rows:
                    if fits(c) and (m := link.search(c[2])):
                        href = m[1] if m[1].startswith("http") else base + m[1]
                        return base + href.split("/ix?doc=")[1] if "/ix?doc=" in href else href
            return None

        return s.map(one)

    return index_pages.withColumn("list_url", find(F.col(markup)))
