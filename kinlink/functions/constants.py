"""Word lists, codes and limits that results depend on."""

# Placeholders that count as no address component.
NULL_PLACEHOLDERS = ["null", "<null>", "n/a", "na", "none", "nan", "-"]

# States of the United States, code and name.
US_STATES = {
    "AL": "alabama", "AK": "alaska", "AZ": "arizona", "AR": "arkansas", "CA": "california", "CO": "colorado", "CT": "connecticut", "DE": "delaware",
    "DC": "district of columbia", "FL": "florida", "GA": "georgia", "HI": "hawaii", "ID": "idaho", "IL": "illinois", "IN": "indiana", "IA": "iowa",
    "KS": "kansas", "KY": "kentucky", "LA": "louisiana", "ME": "maine", "MD": "maryland", "MA": "massachusetts", "MI": "michigan", "MN": "minnesota",
    "MS": "mississippi", "MO": "missouri", "MT": "montana", "NE": "nebraska", "NV": "nevada", "NH": "new hampshire", "NJ": "new jersey", "NM": "new mexico",
    "NY": "new york", "NC": "north carolina", "ND": "north dakota", "OH": "ohio", "OK": "oklahoma", "OR": "oregon", "PA": "pennsylvania",
    "RI": "rhode island", "SC": "south carolina", "SD": "south dakota", "TN": "tennessee", "TX": "texas", "UT": "utah", "VT": "vermont", "VA": "virginia",
    "WA": "washington", "WV": "west virginia", "WI": "wisconsin", "WY": "wyoming", "PR": "puerto rico",
}
# States of India, code and names.
INDIA_STATES = {
    "MH": ["maharashtra", "महाराष्ट्र"], "DL": ["delhi", "nct of delhi", "दिल्ली"], "UP": ["uttar pradesh", "उत्तर प्रदेश"], "KA": ["karnataka", "ಕರ್ನಾಟಕ"],
    "TN": ["tamil nadu", "தமிழ்நாடு"], "GJ": ["gujarat", "ગુજરાત"], "WB": ["west bengal", "পশ্চিমবঙ্গ"], "TG": ["telangana", "తెలంగాణ"],
    "HR": ["haryana", "हरियाणा"], "RJ": ["rajasthan", "राजस्थान"], "KL": ["kerala", "keralam", "കേരളം"], "BR": ["bihar", "बिहार"],
    "MP": ["madhya pradesh", "मध्य प्रदेश"], "AP": ["andhra pradesh", "ఆంధ్రప్రదేశ్"], "PB": ["punjab", "ਪੰਜਾਬ"], "OD": ["odisha", "orissa", "ଓଡ଼ିଶା"],
    "AS": ["assam", "অসম"], "JH": ["jharkhand", "झारखंड"], "CG": ["chhattisgarh", "छत्तीसगढ़"], "UK": ["uttarakhand", "उत्तराखंड", "uttaranchal"],
    "HP": ["himachal pradesh", "हिमाचल प्रदेश"], "GA": ["goa", "गोवा"], "JK": ["jammu and kashmir", "jammu & kashmir"], "PY": ["puducherry", "pondicherry"],
}
# Regions of France with their departements.
FRANCE_REGIONS = {
    "HDF": ["hauts-de-france", "hauts de france", "nord", "pas-de-calais", "pas de calais"],
    "NAQ": ["nouvelle-aquitaine", "nouvelle aquitaine", "gironde"],
    "PDL": ["pays de la loire", "loire-atlantique", "loire atlantique"],
}

# cities' other names.
CITY_ALIASES = {
    "bombay": "mumbai", "calcutta": "kolkata", "bengaluru": "bangalore", "banglore": "bangalore", "gurugram": "gurgaon", "trivandrum": "thiruvananthapuram",
    "vishakhapatnam": "visakhapatnam", "ahmadabad": "ahmedabad", "madras": "chennai", "poona": "pune", "baroda": "vadodara", "cochin": "kochi",
    "mysuru": "mysore", "benares": "varanasi", "kanpur nagar": "kanpur",
}

# Address words, short form and variants.
ADDRESS_WORDS = {
    "st": ["street", "str", "st", "saint", "sreet", "stret"], "ste": ["sainte"], "rd": ["road", "rd"], "ave": ["avenue", "ave", "av", "avn"],
    "dr": ["drive", "dr", "drv"], "ln": ["lane", "ln"], "ct": ["court", "ct", "crt"], "pl": ["place", "pl", "plc"],
    "blvd": ["boulevard", "blvd", "bd", "bvd", "boul"], "pkwy": ["parkway", "pkwy", "pky"], "hwy": ["highway", "hwy"], "ter": ["terrace", "ter", "terr"],
    "cir": ["circle", "cir"], "trl": ["trail", "trl"], "sq": ["square", "sq"], "cres": ["crescent", "cres"], "mkt": ["market", "mkt"],
    "ngr": ["nagar", "ngr"], "rue": ["rue", "r"], "all": ["allee", "all"], "ch": ["chemin", "ch", "chem"], "imp": ["impasse", "imp"],
    "rte": ["route", "rte", "rt"], "fbg": ["faubourg", "fbg"], "rpt": ["rond-point", "rpt"], "qu": ["quai"], "crs": ["cours"],
    "n": ["north", "n", "nord"], "s": ["south", "s", "sud"], "e": ["east", "e", "est"], "w": ["west", "w", "ouest"], "mt": ["mount", "mt"],
    "ft": ["fort", "ft"], "apt": ["apartment", "apt", "flat"], "fl": ["floor", "fl", "flr"], "opp": ["opposite", "opp"], "nr": ["near", "nr"],
    "bldg": ["building", "bldg"], "cplx": ["complex", "cmplx"], "soc": ["society", "soc"], "colony": ["colony", "col"],
    "dist": ["district", "dist", "distt"], "tq": ["taluka", "tq", "tal", "taluk"], "vill": ["village", "vill", "vpo"], "po": ["post"],
    "sec": ["sector", "sec"], "ph": ["phase", "ph"], "extn": ["extension", "extn", "ext"],
}

# Ordinal words, first to twentieth.
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth".split()

# Address words without a place in them.
ADDRESS_DROP = "no number unit suite hno h door plot house office shop pmb box co the of de du des la le les d l and city town county bis".split()

# Street types; the last word of a street component without a number, and words that a rescue ignores.
STREET_TYPES = "st rd ave dr ln ct pl blvd pkwy hwy ter cir trl rue rte ch imp all".split()
RESCUE_STREET_TYPES = "rue st ave rd dr blvd ln all ch imp pl ct cir trl pkwy hwy ter sq rte way".split()

# Labels before a house identifier.
IDENT_LABELS = "hno hn no plot door flat shop sco gala khno kh tc h".split()

# Legal forms and variants.
LEGAL_FORMS = {
    "llc": ["llc", "l l c", "lc"], "inc": ["inc", "incorporated"], "corp": ["corp", "corporation"], "co": ["co", "company", "cos"],
    "ltd": ["ltd", "limited", "ltda"], "pvt": ["pvt", "private", "pte"], "lp": ["lp"], "llp": ["llp"], "pllc": ["pllc"], "pc": ["pc", "p c"], "plc": ["plc"],
    "pa": ["pa"], "sarl": ["sarl"], "sas": ["sas"], "sasu": ["sasu"], "sa": ["sa"], "eurl": ["eurl"], "sci": ["sci"], "snc": ["snc"], "scop": ["scop"],
    "gie": ["gie"], "opc": ["opc"], "gmbh": ["gmbh"], "ei": ["ei"], "cie": ["cie", "compagnie"],
}
LONG_LEGAL = {"private": "pvt", "limited": "ltd", "corporation": "corp", "incorporated": "inc"}
# Words that look like a long legal form and aren't.
NOT_LEGAL = "primate privet pirate liminal limit limits limitless prime corporate corporations limbed lighted privacy privat".split()
# Honorifics and French articles.
HONORIFICS = "dr mr mrs ms m/s shri sri shree smt the messrs de la le les du des et l d".split()
# Digits for letters.
LEET = ("0135476892", "olesatgbgz")
# Spellings of one sound, in order of replacement.
SOUNDS = [("ph", "f"), ("bh", "b"), ("dh", "d"), ("th", "t"), ("kh", "k"), ("gh", "g"), ("sh", "s"), ("ch", "c"), ("ck", "k"), ("q", "k"), ("w", "v"), ("x", "ks"), ("z", "j")]
# States searched with each other, and states that count as equal.
NEIGHBOUR_STATES = {"IN-TG": ["IN-AP"], "IN-AP": ["IN-TG"], "US-DC": ["US-WA"], "US-WA": ["US-DC"]}
STATE_GROUPS = {"IN-TG": "IN-AP", "US-DC": "US-WA"}
# Legal words of synthetic siblings, by country.
SIBLING_LEGAL = {
    "US": ["LLC", "Inc", "Corp", "Co", "Ltd", "LP", "Inc.", "L.L.C.", "Corporation", "Company"],
    "India": ["Pvt Ltd", "Private Limited", "Limited", "LLP", "Ltd", "Pvt. Ltd."],
    "France": ["SAS", "SARL", "SASU", "EURL", "SCI", "SA", "SNC"],
}
# Band edges.
INFLATION_BANDS = [0.3, 0.5, 0.6, 0.7, 0.775, 0.85, 0.9, 0.95, 0.97, 0.99, 1.0001]
CELL_BANDS = [0.3, 0.5, 0.65, 0.775, 0.85, 0.9, 0.95, 0.97, 0.99, 1.01]

DEFAULTS = {
    "k_block": 20, "k_keep": 10, "k_nostate": 40, "train_frac": 0.3, "val_pct": 20, "rounds1": 300, "depth1": 6, "rounds": 3000, "depth2": 7, "s1_recall": 0.9995, "lex_drop": 0.4,
    "fp_weight": 1.9, "neg_weight": 1.0, "p_unfound": 0.02, "min_p": 0.05, "sure": 0.985, "tol": 0.02,
}


def states() -> dict[str, str]:
    """`country|folded key` to state code."""
    out = {}
    for code, name in US_STATES.items():
        out |= {f"US|{code.lower()}": f"US-{code}", f"US|{name}": f"US-{code}"}
    for code, names in INDIA_STATES.items():
        out |= {f"India|{k}": f"IN-{code}" for k in (code.lower(), *names)}
    for code, names in FRANCE_REGIONS.items():
        out |= {f"France|{k}": f"FR-{code}" for k in names}
    return out


def states_anywhere() -> dict[str, str]:
    """Keys of more than three letters without their country; of equal keys the last country's counts."""
    return {k.split("|", 1)[1]: v for k, v in states().items() if len(k.split("|", 1)[1]) > 3}
