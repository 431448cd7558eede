"""Lookup tables with small defaults. `Tables.load` reads larger ones from a folder; every operator and chain takes them as an argument."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

# Countries by tier; a name's first country in this order counts.
TIERS: dict[str, tuple[str, ...]] = {
    "ADVERSARIAL": ("China", "Russia", "Iran", "North Korea", "Belarus", "Myanmar", "Syria", "Cuba", "Venezuela", "Nicaragua"),
    "CONDUIT": (
        "Hong Kong", "Macau", "Singapore", "United Arab Emirates", "Turkey", "Malaysia", "Thailand", "Kazakhstan", "Uzbekistan", "Kyrgyzstan", "Tajikistan", "Turkmenistan", "Armenia", "Georgia", "Azerbaijan",
        "Serbia", "Hungary", "Cyprus", "Malta", "Montenegro", "North Macedonia", "Moldova", "Latvia", "Estonia", "Lithuania",
    ),
    "OPACITY": (
        "Cayman Islands", "British Virgin Islands", "Bermuda", "Bahamas", "Barbados", "Belize", "Curacao", "Antigua and Barbuda", "St. Kitts and Nevis", "St. Vincent and the Grenadines", "Turks and Caicos",
        "Dominica", "Grenada", "St. Lucia", "Anguilla", "Aruba", "US Virgin Islands", "Samoa", "Vanuatu", "Cook Islands", "Marshall Islands", "Nauru", "Niue", "Tonga", "Palau", "Seychelles", "Mauritius",
        "Maldives", "Comoros", "Liechtenstein", "Monaco", "Andorra", "San Marino", "Gibraltar", "Jersey", "Guernsey", "Isle of Man", "Panama", "Uruguay", "Costa Rica", "Bahrain", "Brunei",
    ),
    "MONITORED": (
        "Taiwan", "Pakistan", "Saudi Arabia", "Qatar", "Oman", "Kuwait", "Jordan", "Lebanon", "Iraq", "Libya", "South Africa", "Nigeria", "Kenya", "Tanzania", "Ethiopia", "Egypt", "Morocco", "Tunisia",
        "Algeria", "Ukraine", "Cambodia", "Laos", "Sri Lanka", "Bangladesh", "Nepal", "Mongolia",
    ),
    "STANDARD": (
        "United States", "Canada", "United Kingdom", "Germany", "France", "Switzerland", "Netherlands", "Ireland", "Luxembourg", "Sweden", "Norway", "Denmark", "Finland", "Italy", "Spain", "Belgium", "Austria",
        "Portugal", "Greece", "Poland", "Czech Republic", "Romania", "Bulgaria", "Croatia", "Slovakia", "Slovenia", "Israel", "Japan", "South Korea", "India", "Australia", "New Zealand", "Indonesia",
        "Philippines", "Vietnam", "Mexico", "Brazil", "Argentina", "Chile", "Colombia", "Peru",
    ),
}
#: More tokens than a country's own name, which always is one. A fuller table is an argument's business.
MORE_TOKENS: dict[str, tuple[str, ...]] = {
    "China": ("PRC", "Chinese", "Beijing", "Shanghai", "Shenzhen", "Guangzhou", "Hainan"), "Russia": ("Russian", "Moscow", "Saint Petersburg"), "Iran": ("Iranian", "Tehran"), "North Korea": ("DPRK", "Pyongyang"),
    "Belarus": ("Minsk",), "Myanmar": ("Burma", "Yangon"), "Syria": ("Damascus",), "Cuba": ("Havana",), "Venezuela": ("Caracas",), "Hong Kong": ("Kowloon",), "United Arab Emirates": ("Dubai", "Abu Dhabi"),
    "Turkey": ("Istanbul",), "British Virgin Islands": ("BVI", "Tortola"), "Cayman Islands": ("Cayman",), "Curacao": ("Curaçao",), "Taiwan": ("Taipei",), "United States": ("U.S.", "USA", "Delaware", "Nevada", "New York", "California", "Texas"),
    "United Kingdom": ("UK", "London"), "Germany": ("Frankfurt",), "Japan": ("Tokyo",), "South Korea": ("Korea", "Seoul"),
}
# Country codes of the index scan.
ADVERSARIAL_CODES = {"CN": "China", "RU": "Russia", "IR": "Iran", "KP": "North Korea", "BY": "Belarus", "MM": "Myanmar", "CU": "Cuba", "VE": "Venezuela", "SY": "Syria", "NI": "Nicaragua"}
CONDUIT_CODES = {"HK": "Hong Kong", "SG": "Singapore", "AE": "United Arab Emirates", "KY": "Cayman Islands", "VG": "British Virgin Islands", "BM": "Bermuda", "PA": "Panama", "CY": "Cyprus"}
# Other words for a country in searches.
ALIASES = {
    "prc": "china", "chinese": "china", "russian": "russia", "russian federation": "russia", "iranian": "iran", "dprk": "north korea", "burmese": "myanmar", "burma": "myanmar", "cuban": "cuba",
    "venezuelan": "venezuela", "belarusian": "belarus", "byelorussia": "belarus", "syrian": "syria", "nicaraguan": "nicaragua", "iraqi": "iraq",
}
# Registrants that file for others.
FILING_AGENTS = (
    "1144204", "950159", "1213900", "1628280", "1410578", "1341004", "1275287", "1258897", "1145549", "1013762", "1683168", "1406774", "922423", "950170", "1193125", "1104659", "1140361", "1437749", "1493152",
    "1477932", "1171843", "1185185", "1554795", "1558370", "1580642", "1829126", "1903596", "1445546", "1214659", "1539497", "1062993", "1079973",
)
# Industry codes of critical sectors; a code may be in several.
SECTORS: dict[str, tuple[tuple[int, int], ...]] = {
    "Agriculture & Food": ((100, 999), (2000, 2099), (2010, 2099), (5140, 5159)),
    "Pharmaceuticals & Biotech": ((2830, 2836), (2860, 2869), (3841, 3851), (5122, 5122), (8731, 8734)),
    "Chemicals & Petrochemicals": ((2800, 2829), (2840, 2899), (2910, 2999)),
    "Semiconductors & Electronics": ((3559, 3559), (3570, 3579), (3660, 3699), (3674, 3674), (3710, 3799)),
    "Defense & Aerospace": ((3720, 3729), (3760, 3769), (3812, 3812), (3761, 3769)),
    "Energy & Utilities": ((1300, 1399), (2900, 2912), (4900, 4999)),
    "Telecommunications": ((4800, 4899), (3669, 3669)),
    "Mining & Rare Earth": ((1000, 1499),),
    "Financial Services": ((6000, 6799),),
    "Transportation & Logistics": ((4000, 4799),),
}


@dataclass(frozen=True)
class Jurisdiction:
    country: str
    tier: str
    tokens: tuple[str, ...]


def jurisdictions(more: dict[str, tuple[str, ...]] = MORE_TOKENS) -> list[Jurisdiction]:
    """Countries in order of tier, each with its own name and any more tokens."""
    return [Jurisdiction(c, t, (c, *more.get(c, ()))) for t, names in TIERS.items() for c in names]


@dataclass(frozen=True)
class Affiliation:
    """Keywords that make a name part of a state's apparatus; `gate` are the issuer's countries for which they count (any if empty)."""

    category: str
    sub: str | None
    detail: str
    confidence: float
    gate: tuple[str, ...]
    keywords: tuple[str, ...]


_PRC = ("China", "Hong Kong", "Macau")


def _state(country: str, label: str, confidence: float, *keywords: str, gate: bool = True) -> Affiliation:
    return Affiliation("State-Linked", label, f"Matched {label} state keywords" if gate else f"Matched {label} keywords", confidence, (country,) if gate else (), keywords)


#: Categories and their order are fixed; the keywords are a short list of well-known names.
AFFILIATIONS: tuple[Affiliation, ...] = (
    Affiliation("SOE", "PRC", "Matched PRC SOE keywords", 0.9, _PRC, ("sinopec", "petrochina", "cnooc", "cosco", "state grid", "china mobile", "china telecom", "china railway", "sasac", "bank of china")),
    Affiliation("Party-Controlled", "PRC", "Matched PRC Party keywords", 0.9, _PRC, ("communist party", "party committee", "central committee", "politburo")),
    Affiliation("MCF", "PRC", "Matched PRC MCF keywords", 0.85, _PRC, ("military-civil fusion", "norinco", "avic", "people's liberation army", "defense science")),
    Affiliation("UFWD", "PRC", "Matched PRC UFWD keywords", 0.8, _PRC, ("united front", "overseas chinese", "peaceful reunification")),
    _state("Russia", "Russia", 0.85, "gazprom", "rosneft", "rostec", "sberbank", "vtb", "rosatom", "gru", "fsb"),
    _state("Iran", "Iran", 0.85, "irgc", "bonyad", "khatam", "revolutionary guard", "setad"),
    _state("North Korea", "DPRK", 0.9, "dprk", "korea mining development", "office 39", "mansudae", gate=False),
    _state("Belarus", "Belarus", 0.8, "belaruskali", "belneftekhim"),
    _state("Syria", "Syria", 0.8, "cham holding", "syriatel"),
    _state("Myanmar", "Myanmar", 0.8, "tatmadaw", "myanma economic", "mec"),
    _state("Venezuela", "Venezuela", 0.8, "pdvsa", "petroleos de venezuela"),
    _state("Cuba", "Cuba", 0.8, "gaesa", "cimex"),
    Affiliation("SWF", None, "Matched sovereign wealth fund keywords", 0.8, (), ("sovereign wealth", "china investment corporation", "temasek", "mubadala", "public investment fund", "qatar investment authority")),
    Affiliation("Shell-Proxy", None, "Matched shell/proxy keyword: {}", 0.7, (), ("nominee", "shell company", "special purpose vehicle", "bearer share", "trustee services", "corporate services provider")),
    Affiliation("PEP", None, "Matched PEP keywords", 0.7, (), ("minister", "president of the republic", "ambassador", "senator", "governor", "royal family", "king", "politically exposed")),
)

# Chief officers and what they are chief of; "deputy" before it is the same role.
CHIEFS = {
    "CEO": ("executive",), "CFO": ("financial",), "COO": ("operating",), "CTO": ("technology",), "CIO": ("information",), "CISO": ("information security",), "CLO": ("legal",), "CMO": ("marketing",),
    "CHRO": ("human resources",), "CAO": ("accounting", "administrative"), "CRO": ("risk", "revenue"), "CSO": ("strategy", "sustainability"), "CDO": ("data", "digital"), "CCO": ("compliance", "commercial"),
}
#: Other roles in order, with their words; the first that occurs counts. A fuller table is an argument's business.
OTHER_ROLES: dict[str, tuple[str, ...]] = {
    "Chairman": ("chairman", "chairwoman", "chairperson", "chair of the board"), "Vice Chairman": ("vice chairman", "deputy chairman"), "Director": ("director", "board member", "member of the board"),
    "Lead Independent Director": ("lead independent director", "presiding director"), "Non-Executive Director": ("non-executive director", "ined"), "Supervisory Board": ("supervisory board member", "supervisor"),
    "Vice President": ("vice president", "evp", "svp", "avp"), "President": ("president",), "Managing Director": ("managing director",), "Executive Director": ("executive director",), "General Manager": ("general manager",),
    "Principal Financial Officer": ("principal financial officer",), "Principal Accounting Officer": ("principal accounting officer",), "Principal Executive Officer": ("principal executive officer",),
    "Authorized Representative": ("authorized representative", "authorized signatory", "authorized officer"), "Reporting Person": ("reporting person", "filing person"), "Treasurer": ("treasurer",), "Controller": ("controller", "comptroller"),
    "Secretary": ("secretary",), "General Counsel": ("general counsel",), "Partner": ("partner",), "Trustee": ("trustee",), "Beneficial Owner": ("beneficial owner",), "Controlling Person": ("controlling person", "controlling shareholder"),
    "Significant Shareholder": ("significant shareholder", "principal shareholder"), "Owner": ("owner",), "Nominee": ("nominee", "nominal holder"), "Agent": ("registered agent", "resident agent", "formation agent"),
    "Proxy": ("proxy holder", "proxy", "attorney-in-fact", "power of attorney"), "Intermediary": ("intermediary", "conduit", "pass-through"), "Settlor": ("settlor", "grantor", "trustor"), "Protector": ("protector", "enforcer"), "Founder": ("founder", "co-founder"),
}
# Roles by kind.
EXECUTIVE_ROLES = (*CHIEFS, "President", "Vice President", "Managing Director", "Executive Director", "General Manager", "Principal Financial Officer", "Principal Accounting Officer", "Principal Executive Officer", "Deputy Chief")
BOARD_ROLES = ("Chairman", "Vice Chairman", "Director", "Deputy Director", "Lead Independent Director", "Non-Executive Director")
SUPERVISORY_ROLES = ("Supervisory Board",)
OWNERSHIP_ROLES = ("Owner", "Beneficial Owner", "Controlling Person", "Significant Shareholder", "Majority Owner", "Minority Owner", "Founder")
OBSCURING_ROLES = ("Nominee", "Agent", "Proxy", "Intermediary", "Settlor", "Protector")


def roles(others: dict[str, tuple[str, ...]] = OTHER_ROLES) -> list[tuple[str, tuple[str, ...]]]:
    """Roles with their words, in order: chief officers by rule, then the others."""
    chief = [(r, tuple(f"{d}chief {x} officer" for x in of for d in ("deputy ", "")) + ((r.lower(),) if r in ("CEO", "CFO", "COO") else ())) for r, of in CHIEFS.items()]
    return chief + list(others.items())


#: Categories of search terms, in order.
TERM_KINDS = ("country_names", "soe_names", "strategic_names", "city_names", "legal_suffixes")


def expansions() -> dict[str, dict[str, tuple[str, ...]]]:
    """Search terms of each adversarial country, from the tables above: its tokens are names, its keywords state-owned names. Terms of the other three kinds come from a file (Tables.load)."""
    by_country: dict[str, dict[str, tuple[str, ...]]] = {}
    for c in TIERS["ADVERSARIAL"]:
        owned = tuple(k for a in AFFILIATIONS if c in a.gate or a.sub == {"North Korea": "DPRK"}.get(c, c) for k in a.keywords)
        by_country[c.lower()] = {"country_names": (c, *MORE_TOKENS.get(c, ())), "soe_names": owned}
    return by_country


def read(spark: SparkSession, path: str, key: str, value: str, order: str | None = None) -> dict[str, tuple[str, ...]]:
    """A lookup table from a CSV file with a header: the values of each key, both in the order of the file or of a column."""
    out: dict[str, list[str]] = {}
    for r in _rows(spark, path, order):
        out.setdefault(r[key], []).append(r[value])
    return {k: tuple(v) for k, v in out.items()}


#: Rows of a table file; a lookup table is read whole, so it has a bound.
MOST_ROWS = 200_000


def _rows(spark: SparkSession, path: str, order: str | None = None) -> list:
    rows = spark.read.option("header", True).csv(path).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"{path} has over {MOST_ROWS} rows")
    return sorted(rows, key=lambda r: int(r[order])) if order else rows


@dataclass(frozen=True)
class Tables:
    """The lookup tables that edges are built with: all defaults, or those of a folder."""

    jurisdictions: tuple[Jurisdiction, ...] = field(default_factory=lambda: tuple(jurisdictions()))
    affiliations: tuple[Affiliation, ...] = AFFILIATIONS
    roles: tuple[tuple[str, tuple[str, ...]], ...] = field(default_factory=lambda: tuple(roles()))
    expansions: dict[str, dict[str, tuple[str, ...]]] = field(default_factory=expansions)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Tables:
        """Tables from CSV files of a folder, in the files' order; a file that isn't there leaves the default.

        jurisdictions.csv: tier, country, token. affiliations.csv: category, sub, detail, confidence, gate (countries with ; between),
        keyword. roles.csv: role, phrase. terms.csv: country, kind, term. Rows of one entry need not stand together; an entry
        stands where its first row does. Any number of tokens costs one automaton.
        """
        own: dict[str, object] = {}

        def grouped(name: str, keys: tuple[str, ...], value: str) -> dict[tuple, tuple[str, ...]] | None:
            path = f"{folder.rstrip('/')}/{name}.csv"
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
                return None
            out: dict[tuple, list[str]] = {}
            for r in _rows(spark, path):
                if missing := [c for c in (*keys, value) if c not in r]:
                    raise ValueError(f"{path} has no column {', '.join(missing)}")
                out.setdefault(tuple(r[k] for k in keys), []).append(r[value] or "")
            return {k: tuple(v) for k, v in out.items()}

        if (t := grouped("jurisdictions", ("tier", "country"), "token")) is not None:
            own["jurisdictions"] = tuple(Jurisdiction(c, tier, tokens) for (tier, c), tokens in t.items())
        if (t := grouped("affiliations", ("category", "sub", "detail", "confidence", "gate"), "keyword")) is not None:
            own["affiliations"] = tuple(Affiliation(c, sub or None, detail or "", float(conf), tuple(g for g in (gate or "").split(";") if g), tuple(k.lower() for k in words)) for (c, sub, detail, conf, gate), words in t.items())
        if (t := grouped("roles", ("role",), "phrase")) is not None:
            own["roles"] = tuple((r, words) for (r,), words in t.items())
        if (t := grouped("terms", ("country", "kind"), "term")) is not None:
            terms: dict[str, dict[str, tuple[str, ...]]] = {}
            for (country, kind), found in t.items():
                if kind not in TERM_KINDS:
                    raise ValueError(f"{kind} is no kind of search term")
                terms.setdefault(country.lower(), {})[kind] = found
            own["expansions"] = terms
        return cls(**own)


DEFAULT = Tables()
