"""Fixed values of the domain: word lists, lookup tables and thresholds.

Results follow from these values, so they are stated as they are. Each operator
that uses one takes it as a parameter with this default.
"""

#: label -> phrases that the dictionary tagger knows.
PHRASES = {
    "VC_FIRM": (
        "Sequoia Capital", "Sequoia", "Andreessen Horowitz", "a16z", "Kleiner Perkins", "KPCB", "Y Combinator", "YC", "Benchmark Capital",
        "Accel Partners", "Accel", "Tiger Global", "General Catalyst", "Lightspeed Venture Partners", "Greylock Partners", "Founders Fund",
        "Index Ventures", "NEA",
    ),
    "FUNDING_ROUND": ("Series A", "Series B", "Series C", "Series D", "seed round", "seed funding", "angel round"),
    "EXIT_TYPE": ("IPO", "initial public offering", "acquisition", "merger"),
    "SECTOR": ("SaaS", "FinTech", "HealthTech", "EdTech", "AI/ML", "enterprise software", "consumer internet", "deep tech", "clean tech", "biotech"),
}
KEPT_LABELS = ("ORG", "PERSON", "GPE", "PRODUCT", "VC_FIRM", "FUNDING_ROUND", "EXIT_TYPE", "SECTOR")

MIN_SENTENCE = 40
MIN_MENTIONS = 3
#: Most entities a label keeps (None: all), and of a label that isn't named here.
LABEL_CAPS = {"PERSON": 50, "ORG": 50, "GPE": 30, "PRODUCT": 20, "VC_FIRM": None, "FUNDING_ROUND": None, "EXIT_TYPE": None, "SECTOR": None}
OTHER_CAP = 30

#: Local names of the classes; GPE is a literal, never a node.
LABEL_CLASSES = {"VC_FIRM": "VCFirm", "ORG": "Company", "PERSON": "Person", "SECTOR": "Sector", "PRODUCT": "Company", "FUNDING_ROUND": "FundingRound", "EXIT_TYPE": "ExitEvent"}
LABEL_OVERRIDES = {w: "SECTOR" for w in ("fintech", "saas", "ai", "ai/ml", "deep tech", "clean tech", "biotech", "edtech", "healthtech")}
CLASS_OVERRIDES = {w: "Organization" for w in ("stanford university", "stanford", "harvard", "mit", "yale", "columbia", "oxford", "cambridge")}
BLOCKLIST = (
    "marc andreessen marc", "thiel capital thiel capital", "valar ventures valar venture", "anduril industries anduril", "vc shaun maguire",
    "pronomos capital thiel", "starinvestor peter thiel", "tap into trump", "thiel to epstein", "peter thiel political campaign contribution",
    "moira weigel palantir", "lowell andreessen", "rooney, kate", "fbi", "isbn", "dei", "the white house", "sri lanka guardian",
    "quantum system", "loizo", "breakout lab", "breakout venture", "yc", "a16z", "vc",
)
ROUND_NAMES = {"series a": "SeriesA", "series b": "SeriesB", "series c": "SeriesC", "series d": "SeriesD", "seed round": "SeedRound", "seed funding": "SeedRound", "angel round": "SeedRound"}
EXIT_NAMES = {"ipo": "IPO", "initial public offering": "IPO", "acquisition": "Acquisition", "merger": "Merger"}

#: (predicate, subject labels, object labels, any of these words; none: always)
RELATIONS = (
    ("foundedBy", ("ORG", "VC_FIRM"), ("PERSON",), ("founded", "co-founded", "cofounded", "started", "created")),
    ("investedIn", ("VC_FIRM",), ("ORG",), ("invested", "investment", "backed", "funded", "portfolio", "lead investor")),
    ("partnerAt", ("PERSON",), ("VC_FIRM",), ("partner", "general partner", "managing partner", "joined", "co-founder of")),
    ("ceoOf", ("PERSON",), ("ORG", "VC_FIRM"), ("ceo", "chief executive", "leads", "runs", "head of")),
    ("operatesIn", ("ORG", "VC_FIRM"), ("SECTOR",), ()),
    ("hasFundingRound", ("ORG",), ("FUNDING_ROUND",), ()),
    ("hadExit", ("ORG",), ("EXIT_TYPE",), ()),
)
SEAT_WORDS = ("headquartered in", "headquartered at", "based in", "based out of", "located in", "located at", "offices in", "office in", "founded in")
SEAT_LABELS = ("ORG", "VC_FIRM")

SAME, CLOSE = "0.85", "0.70"
FORCED = {
    "Twitter": "Q918", "Harvard": "Q13371", "MIT": "Q49108", "The New York Time": "Q9684", "Rene Girard": "Q129228", "Leo Strau": "Q77144", "Palantir": "Q2047336",
}
LOCAL_CLASSES = {
    "René Girard": "PublicFigure", "Leo Strauss": "PublicFigure", "Jim Clark": "Founder", "Owen Thomas": "PublicFigure",
    "The Thiel Foundation": "NonProfit", "the Thiel Fellowship": "NonProfit", "Sri Lanka Guardian": "MediaOutlet",
}
TYPE_HINTS = {
    "VC_FIRM": ("venture capital", "investment firm", "private equity", "fund"),
    "ORG": ("company", "corporation", "startup", "software", "technology", "platform", "service", "business", "enterprise"),
    "PERSON": ("investor", "entrepreneur", "businessman", "founder", "executive", "computer scientist", "engineer", "philanthropist"),
    "SECTOR": ("industry", "sector", "technology", "field"),
    "PRODUCT": ("software", "application", "platform", "product", "service"),
}
#: (local name, keyword, known pairs, chosen property, relation)
PREDICATES = (
    ("investedIn", "participant of", (("Q1852025", "Q63327"),), "P1344", "closeMatch"),
    ("foundedBy", "founded", (("Q210057", "Q62882"),), "P112", "equivalentProperty"),
    ("partnerAt", "employer", (("Q62882", "Q4034010"),), "P108", "closeMatch"),
    ("ceoOf", "chief executive", (("Q36215", "Q355"),), "P169", "equivalentProperty"),
    ("worksAt", "employer", (("Q317521", "Q2616400"),), "P108", "equivalentProperty"),
    ("operatesIn", "industry", (("Q2283", "Q16319025"),), "P452", "equivalentProperty"),
    ("hasFundingRound", "funded", (), "P8324", "closeMatch"),
    ("acquiredBy", "acquisition", (), "P1642", "closeMatch"),
    ("headquarteredIn", "headquarters", (), "P159", "closeMatch"),
    ("fundedBy", None, (), None, None),
    ("founderOf", None, (), None, None),
    ("hadExit", None, (), None, None),
)
LABEL_HITS = 8

#: Properties that expansion keeps.
KEPT_PROPERTIES = (
    "P571", "P576", "P31", "P279", "P112", "P169", "P1037", "P488", "P3320", "P6", "P108", "P463", "P39", "P106",
    "P1344", "P8324", "P749", "P355", "P127", "P1830", "P199", "P361", "P527", "P1365", "P1366", "P159", "P17", "P131",
    "P150", "P276", "P452", "P414", "P856", "P1128", "P2139", "P2226", "P2295", "P2541", "P1454", "P1056", "P69", "P27",
    "P19", "P569", "P570", "P21", "P26", "P40", "P22", "P25", "P3373", "P101", "P1412", "P166", "P7", "P737",
)
ANCHORS = ("Q1852025", "Q4034010", "Q2616400", "Q705525", "Q62882", "Q7407093")
INCOMING = (("P108", 1000), ("P1344", 2000), ("P112", 1000), ("P355", 500), ("P127", 500))
ANCHOR_LIMIT, ALIGNED_LIMIT, OUTGOING_LIMIT, NEW_LIMIT, NEW_ENTITIES = 5000, 1000, 1000, 500, 8000

#: What training data leaves out.
LITERAL_PROPERTIES = (
    "http://www.wikidata.org/prop/direct/P569",
    "http://www.wikidata.org/prop/direct/P570",
    "http://www.wikidata.org/prop/direct/P571",
    "http://www.wikidata.org/prop/direct/P576",
    "http://www.wikidata.org/prop/direct/P580",
    "http://www.wikidata.org/prop/direct/P582",
    "http://www.wikidata.org/prop/direct/P585",
    "http://www.wikidata.org/prop/direct/P2226",
    "http://www.wikidata.org/prop/direct/P1082",
    "http://www.wikidata.org/prop/direct/P2139",
    "http://www.wikidata.org/prop/direct/P2295",
    "http://www.wikidata.org/prop/direct/P1128",
    "http://www.w3.org/2000/01/rdf-schema#label",
    "http://schema.org/description",
    "http://www.wikidata.org/prop/direct/P856",
    "http://www.wikidata.org/prop/direct/P18",
    "http://www.wikidata.org/prop/direct/P154",
    "http://www.wikidata.org/prop/direct/P1412",
)
HUB_PROPERTIES = ("http://www.wikidata.org/prop/direct/P21",)
HUB_OBJECTS = {
    "http://www.wikidata.org/prop/direct/P31": (
        "http://www.wikidata.org/entity/Q5",
        "http://www.wikidata.org/entity/Q6581097",
        "http://www.wikidata.org/entity/Q6581072",
    ),
}
SCHEMA_PARTS = ("22-rdf-syntax-ns#type", "owl#sameAs", "owl#equivalentProperty", "owl#imports")
PROTECTED_PARTS = ("ontology#",)

#: instance-of value -> class, and properties whose subjects are people.
INSTANCE_CLASSES = {
    "Q4830453": "Company",
    "Q783794": "Company",
    "Q6881511": "Company",
    "Q891723": "Company",
    "Q210167": "Company",
    "Q1156831": "Company",
    "Q43229": "Organization",
    "Q163740": "Organization",
    "Q23002054": "Organization",
    "Q31855": "Organization",
    "Q38723": "Organization",
    "Q3918": "Organization",
    "Q1076486": "Organization",
    "Q7397": "Tech/Product",
    "Q35127": "Tech/Product",
    "Q1668024": "Tech/Product",
    "Q9143": "Tech/Product",
}
PERSON_PROPERTIES = (
    "http://www.wikidata.org/prop/direct/P106",
    "http://www.wikidata.org/prop/direct/P69",
    "http://www.wikidata.org/prop/direct/P19",
    "http://www.wikidata.org/prop/direct/P22",
    "http://www.wikidata.org/prop/direct/P25",
    "http://www.wikidata.org/prop/direct/P26",
    "http://www.wikidata.org/prop/direct/P40",
    "http://www.wikidata.org/prop/direct/P3373",
)
OWN_CLASSES = {"VCFirm": "VC Firm", "Person": "Person", "Company": "Company", "Organization": "Organization"}
