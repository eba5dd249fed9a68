"""Word lists with weights, streams and limits of the generated data."""

from __future__ import annotations

from pathlib import Path


# All values below are fixed by the format of the generated data, their order included.

REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]

# Nation with the step from the region of the nation before it.
NATION_STEPS = [
    ("ALGERIA", 0), ("ARGENTINA", 1), ("BRAZIL", 0), ("CANADA", 0), ("EGYPT", 3),
    ("ETHIOPIA", -4), ("FRANCE", 3), ("GERMANY", 0), ("INDIA", -1), ("INDONESIA", 0),
    ("IRAN", 2), ("IRAQ", 0), ("JAPAN", -2), ("JORDAN", 2), ("KENYA", -4), ("MOROCCO", 0),
    ("MOZAMBIQUE", 0), ("PERU", 1), ("CHINA", 1), ("ROMANIA", 1), ("SAUDI ARABIA", 1),
    ("VIETNAM", -2), ("RUSSIA", 1), ("UNITED KINGDOM", 0), ("UNITED STATES", -2),
]
NATIONS = [name for name, _ in NATION_STEPS]

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
INSTRUCTIONS = ["DELIVER IN PERSON", "COLLECT COD", "TAKE BACK RETURN", "NONE"]
SHIP_MODES = ["REG AIR", "AIR", "RAIL", "TRUCK", "MAIL", "FOB", "SHIP"]
RETURN_FLAGS = ["R", "A"]

BOX_SIZES = ["SM", "LG", "MED", "JUMBO", "WRAP"]
BOX_KINDS = ["CASE", "BOX", "BAG", "JAR", "PACK", "PKG", "CAN", "DRUM"]
CONTAINERS = [f"{size} {kind}" for size in BOX_SIZES for kind in BOX_KINDS]

TYPE_CLASSES = ["STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY", "PROMO"]
TYPE_FINISHES = ["ANODIZED", "BURNISHED", "PLATED", "POLISHED", "BRUSHED"]
TYPE_METALS = ["TIN", "NICKEL", "BRASS", "STEEL", "COPPER"]
PART_TYPES = [f"{a} {b} {c}" for a in TYPE_CLASSES for b in TYPE_FINISHES for c in TYPE_METALS]

COLOURS = [
    "almond", "antique", "aquamarine", "azure", "beige", "bisque", "black", "blanched", "blue",
    "blush", "brown", "burlywood", "burnished", "chartreuse", "chiffon", "chocolate", "coral",
    "cornflower", "cornsilk", "cream", "cyan", "dark", "deep", "dim", "dodger", "drab",
    "firebrick", "floral", "forest", "frosted", "gainsboro", "ghost", "goldenrod", "green",
    "grey", "honeydew", "hot", "indian", "ivory", "khaki", "lace", "lavender", "lawn", "lemon",
    "light", "lime", "linen", "magenta", "maroon", "medium", "metallic", "midnight", "mint",
    "misty", "moccasin", "navajo", "navy", "olive", "orange", "orchid", "pale", "papaya",
    "peach", "peru", "pink", "plum", "powder", "puff", "purple", "red", "rose", "rosy", "royal",
    "saddle", "salmon", "sandy", "seashell", "sienna", "sky", "slate", "smoke", "snow",
    "spring", "steel", "tan", "thistle", "tomato", "turquoise", "violet", "wheat", "white",
    "yellow",
]

NOUNS = [
    ("packages", 40), ("requests", 40), ("accounts", 40), ("deposits", 40), ("foxes", 20),
    ("ideas", 20), ("theodolites", 20), ("pinto beans", 20), ("instructions", 20),
    ("dependencies", 10), ("excuses", 10), ("platelets", 10), ("asymptotes", 10), ("courts", 5),
    ("dolphins", 5), ("multipliers", 1), ("sauternes", 1), ("warthogs", 1), ("frets", 1),
    ("dinos", 1), ("attainments", 1), ("somas", 1), ("Tiresias", 1), ("patterns", 1),
    ("forges", 1), ("braids", 1), ("frays", 1), ("warhorses", 1), ("dugouts", 1),
    ("notornis", 1), ("epitaphs", 1), ("pearls", 1), ("tithes", 1), ("waters", 1),
    ("orbits", 1), ("gifts", 1), ("sheaves", 1), ("depths", 1), ("sentiments", 1),
    ("decoys", 1), ("realms", 1), ("pains", 1), ("grouches", 1), ("escapades", 1),
    ("hockey players", 1),
]
VERBS = [
    ("sleep", 20), ("wake", 20), ("are", 20), ("cajole", 20), ("haggle", 20), ("nag", 10),
    ("use", 10), ("boost", 10), ("affix", 5), ("detect", 5), ("integrate", 5), ("maintain", 1),
    ("nod", 1), ("was", 1), ("lose", 1), ("sublate", 1), ("solve", 1), ("thrash", 1),
    ("promise", 1), ("engage", 1), ("hinder", 1), ("print", 1), ("x-ray", 1), ("breach", 1),
    ("eat", 1), ("grow", 1), ("impress", 1), ("mold", 1), ("poach", 1), ("serve", 1),
    ("run", 1), ("dazzle", 1), ("snooze", 1), ("doze", 1), ("unwind", 1), ("kindle", 1),
    ("play", 1), ("hang", 1), ("believe", 1), ("doubt", 1),
]
ADVERBS = [
    ("sometimes", 1), ("always", 1), ("never", 1), ("furiously", 50), ("slyly", 50),
    ("carefully", 50), ("blithely", 40), ("quickly", 30), ("fluffily", 20), ("slowly", 1),
    ("quietly", 1), ("ruthlessly", 1), ("thinly", 1), ("closely", 1), ("doggedly", 1),
    ("daringly", 1), ("bravely", 1), ("stealthily", 1), ("permanently", 1), ("enticingly", 1),
    ("idly", 1), ("busily", 1), ("regularly", 1), ("finally", 1), ("ironically", 1),
    ("evenly", 1), ("boldly", 1), ("silently", 1),
]
PREPOSITIONS = [
    ("about", 50), ("above", 50), ("according to", 50), ("across", 50), ("after", 50),
    ("against", 40), ("along", 40), ("alongside of", 30), ("among", 30), ("around", 20),
    ("at", 10), ("atop", 1), ("before", 1), ("behind", 1), ("beneath", 1), ("beside", 1),
    ("besides", 1), ("between", 1), ("beyond", 1), ("by", 1), ("despite", 1), ("during", 1),
    ("except", 1), ("for", 1), ("from", 1), ("in place of", 1), ("inside", 1),
    ("instead of", 1), ("into", 1), ("near", 1), ("of", 1), ("on", 1), ("outside", 1),
    ("over", 1), ("past", 1), ("since", 1), ("through", 1), ("throughout", 1), ("to", 1),
    ("toward", 1), ("under", 1), ("until", 1), ("up", 1), ("upon", 1), ("whithout", 1),
    ("with", 1), ("within", 1),
]
AUXILIARIES = [
    ("do", 1), ("may", 1), ("might", 1), ("shall", 1), ("will", 1), ("would", 1), ("can", 1),
    ("could", 1), ("should", 1), ("ought to", 1), ("must", 1), ("will have to", 1),
    ("shall have to", 1), ("could have to", 1), ("should have to", 1), ("must have to", 1),
    ("need to", 1), ("try to", 1),
]
TERMINATORS = [(".", 50), (";", 1), (":", 1), ("?", 1), ("!", 1), ("--", 1)]
ADJECTIVES = [
    ("special", 20), ("pending", 20), ("unusual", 20), ("express", 20), ("furious", 1),
    ("sly", 1), ("careful", 1), ("blithe", 1), ("quick", 1), ("fluffy", 1), ("slow", 1),
    ("quiet", 1), ("ruthless", 1), ("thin", 1), ("close", 1), ("dogged", 1), ("daring", 1),
    ("brave", 1), ("stealthy", 1), ("permanent", 1), ("enticing", 1), ("idle", 1), ("busy", 1),
    ("regular", 50), ("final", 40), ("ironic", 40), ("even", 30), ("bold", 20), ("silent", 10),
]

# Sentence forms: noun phrase, verb phrase, prepositional phrase, terminator.
SENTENCES = [("N V T", 3), ("N V P T", 3), ("N V N T", 3), ("N P V N T", 1), ("N P V P T", 1)]
NOUN_PHRASES = [("N", 10), ("J N", 20), ("J, J N", 10), ("D J N", 50)]
VERB_PHRASES = [("V", 30), ("X V", 1), ("V D", 40), ("X V D", 1)]

# Words the comment query asks for.
QUERY_ADJECTIVES = ADJECTIVES[:4]
QUERY_NOUNS = NOUNS[:4]

ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ,"

# Random streams: start value and draws reserved per row of the owning table.
STREAMS: dict[str, tuple[int, int]] = {
    "part_mfgr": (1, 1),
    "part_brand": (46831694, 1),
    "part_type": (1841581359, 1),
    "part_size": (1193163244, 1),
    "part_container": (727633698, 1),
    "text_pool": (933588178, 1),
    "part_comment": (804159733, 2),
    "partsupp_quantity": (1671059989, 4),
    "partsupp_cost": (1051288424, 4),
    "partsupp_comment": (1961692154, 8),
    "order_clerk": (1171034773, 1),
    "order_comment": (276090261, 2),
    "order_date": (1066728069, 1),
    "line_quantity": (209208115, 7),
    "line_discount": (554590007, 7),
    "line_tax": (721958466, 7),
    "line_instruction": (1371272478, 7),
    "line_mode": (675466456, 7),
    "line_part": (1808217256, 7),
    "line_supplier": (2095021727, 7),
    "line_ship": (1769349045, 7),
    "line_commit": (904914315, 7),
    "line_receipt": (373135028, 7),
    "line_return": (717419739, 7),
    "line_comment": (1095462486, 14),
    "customer_address": (881155353, 9),
    "customer_nation": (1489529863, 1),
    "customer_phone": (1521138112, 3),
    "customer_balance": (298370230, 1),
    "customer_segment": (1140279430, 1),
    "customer_comment": (1335826707, 2),
    "supplier_address": (706178559, 9),
    "supplier_nation": (110356601, 1),
    "supplier_phone": (884434366, 3),
    "supplier_balance": (962338209, 1),
    "supplier_comment": (1341315363, 2),
    "part_name": (709314158, 92),
    "order_priority": (591449447, 1),
    "order_customer": (851767375, 1),
    "nation_comment": (606179079, 2),
    "region_comment": (1500869201, 2),
    "order_lines": (1434868289, 1),
    "notice_gap": (263032577, 1),
    "notice_kind": (753643799, 1),
    "notice_pick": (202794285, 1),
    "notice_offset": (715851524, 1),
}

# Average comment lengths; a length lies between 0.4 and 1.6 times the average.
COMMENT_AVERAGE = {
    "part_comment": 14, "partsupp_comment": 124, "order_comment": 49, "line_comment": 27,
    "customer_comment": 73, "supplier_comment": 63, "nation_comment": 72, "region_comment": 72,
}
ADDRESS_AVERAGE = 25

POOL_CHARACTERS = 300 * 1024 * 1024
START_DATE = "1992-01-01"
CUTOFF_DATE = "1995-06-17"
DAYS = 2557

# Query order of each stream, one per line.
QUERY_ORDERS = [
    tuple(map(int, line.split(",")))
    for line in Path(__file__).with_name("query_orders.csv").read_text().split()
]
