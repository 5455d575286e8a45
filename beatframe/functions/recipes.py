"""The query lists and descriptions that scene rewrites put in."""

# Action queries by subject: needles, queries.
ACTION_RECIPES = (
    (("молок", "milk", "carton", "dairy"), ("person taking milk carton from shelf", "hand holding milk carton grocery store", "customer checking milk label")),
    (("упаков", "package", "packaging", "label"), ("hands holding product package", "person reading package label", "food packaging close up hands")),
    (("корзин", "тележ", "cart", "basket"), ("shopper pushing shopping cart", "person putting groceries in cart", "shopping cart moving supermarket")),
    (("цен", "дороже", "подорож", "price", "expensive", "cost"), ("customer checking price tag", "hand comparing grocery prices", "shopper looking at receipt")),
    (("нагл", "обман", "скрыва", "хитр", "deceptive", "trick", "shrinkflation"), ("customer comparing two product packages", "person reading package suspiciously", "hands comparing product sizes grocery store")),
    (("деньг", "монет", "налич", "money", "cash", "coins"), ("hand counting cash close up", "person paying at checkout", "coins in hand close up")),
    (("телефон", "смартф", "phone", "smartphone"), ("person using smartphone close up", "hand scrolling phone screen", "person checking phone reaction")),
    (("машин", "авто", "car", "vehicle"), ("person driving car interior", "car moving street close shot", "hand opening car door")),
    (("производител", "фабрик", "завод", "manufacturer", "factory", "production"), ("factory packaging products production line", "workers packing products factory", "production line moving packages")),
    (("собак", "пёс", "dog"), ("dog reacting to owner", "dog moving indoors close up", "dog looking around alert")),
    (("кот", "кошк", "cat"), ("cat reacting indoors close up", "cat walking room", "cat looking at owner")),
)
ACTION_MARKER = "Show a clear moving subject performing a visible action."
ACTION_NOTE = (
    "Prefer real human/animal/hands/object interaction footage over static objects, posters, diagrams or generic "
    "establishing shots. The main subject must remain easy to understand in a vertical Short."
)

# Video-first style: needles, queries, in order.
STYLE_AWAKE = ("проснул", "просып", "woke", "wake")
STYLE_AWAKE_QUERIES = ("man waking up suddenly in bed", "person waking from dream surprised", "sleeping man wakes up reaction")
STYLE_RECIPES = (
    (("экзам", "госэкзам", "test", "exam"), ("student taking exam writing paper", "man stressed during exam", "student writing test close up")),
    (("провал", "не сдал", "стресс", "нерв", "разочар", "failed", "failure", "stress"), ("frustrated man disappointed reaction", "stressed man sitting alone", "anxious man emotional reaction")),
    (("спал", "сон", "проснул", "просып", "sleep", "dream", "woke", "wake"), ("man sleeping in bed", "person having vivid dream sleeping", "sleeping person close up")),
    (("иисус", "христ", "бог", "религи", "видение", "jesus", "christ", "relig", "vision"), ("person experiencing spiritual revelation bright light", "man praying dramatic church light", "mystical religious vision person")),
    (("арм", "войск", "солдат", "крестьян", "повстан", "восстан", "army", "troops", "soldier", "rebel"), ("soldiers marching crowd cinematic footage", "army marching people action", "historical reenactment soldiers marching")),
    (("погиб", "жертв", "смерт", "миллион", "унесл", "death", "killed", "casualt", "million"), ("war aftermath destroyed buildings people", "somber ruins aftermath conflict", "mourning people tragedy documentary")),
    (("китай", "китайск", "china", "chinese"), ("China people street documentary footage", "Chinese crowd walking cinematic footage", "China city people b roll")),
)
STYLE_ACTION = ("идет", "идут", "беж", "едет", "говор", "пиш", "крич", "смотр", "берет", "doing", "walking", "running")
STYLE_NOTE = (
    "Prefer real moving footage with a clear human/animal/action subject, natural motion, no text, no static poster, "
    "no map unless explicitly required."
)

# Beat grammar by role: queries, description, visual mode, source mode (empty keeps the scene's own).
ARMY_STORY = ("Taiping Rebellion soldiers", "19th century Chinese rebel army", "Chinese peasant rebel army engraving", "Qing dynasty soldiers historical illustration")
ARMY_PLAIN = ("historical rebel army engraving", "peasant soldiers historical illustration", "historical troops marching engraving")
AFTERMATH_STORY = ("Taiping Rebellion destruction aftermath", "19th century China war devastation", "Taiping Rebellion ruins historical illustration", "war casualties mourning historical China")
AFTERMATH_PLAIN = ("war devastation aftermath historical", "battlefield aftermath mourning", "ruined city historical conflict")
BATTLE_STORY = ("Taiping Rebellion battle", "19th century Chinese battle engraving", "Qing dynasty battle illustration")
BATTLE_PLAIN = ("historical battle engraving", "soldiers fighting historical illustration")
GRAMMAR = {
    "reaction": (
        ("stressed disappointed man reaction", "anxious frustrated man close up", "person reacting to failure documentary b roll"),
        "a human emotional reaction to failure or stress; clear face, no text", "video", "stock_video",
    ),
    "awakening": (
        ("man waking suddenly from sleep", "person waking from vivid dream", "surprised man sitting up in bed"),
        "a person waking abruptly after an intense dream; human reaction first", "video", "stock_video",
    ),
    "revelation": (
        ("surreal religious vision heavenly light person", "mystical spiritual revelation human figure", "dreamlike biblical vision person seeing light"),
        "a human experiencing a surreal religious revelation; dreamlike sacred imagery, not a static portrait", "image", "generic_image",
    ),
    "vision": (
        ("surreal dream vision person", "mystical hallucination human silhouette", "dreamlike revelation cinematic image"),
        "a surreal dream or vision experienced by a person; atmospheric and readable in vertical crop", "image", "generic_image",
    ),
}
GRAMMAR_ARMY = "historical rebel army or soldiers in action; people and movement, not religious iconography"
GRAMMAR_AFTERMATH = "somber aftermath of conflict, destruction or mourning; historically compatible and never cheerful"
GRAMMAR_BATTLE = "historical battle or violent action with clear human activity"

# Overrides of an external direction.
DIRECTION_CHRISTIAN = ("Jesus Christ painting", "Christian religious painting", "biblical vision Jesus", "Jesus Christ religious art")
DIRECTION_CHRISTIAN_TEXT = "Christian religious imagery associated with Jesus Christ, spiritual revelation or biblical symbolism; no unrelated religion"
DIRECTION_ARMY_TEXT = "historical peasant rebel army or soldiers marching; documentary archival illustration"

# Repair variations: what is appended to the base query. Topic: needles, endings.
VARIATION_LOCKED = (
    ("historical engraving", "archival illustration", "full scene"),
    ("different engraving", "full body historical", "period illustration"),
    ("alternate historical depiction", "archival print", "different composition"),
)
VARIATION_ARMY = ("арм", "солдат", "войск", "восстан", "army", "soldier", "troops", "rebellion")
VARIATION_ARMY_ARCHIVE = ("wide army scene", "soldiers marching engraving", "battle crowd detail", "weapons uniforms detail")
VARIATION_ARMY_STOCK = ("soldiers wide shot", "marching crowd", "military detail", "battlefield environment")
VARIATION_DREAM = ("сон", "проснул", "видение", "dream", "wake", "vision")
VARIATION_DREAM_FIRST = ("waking reaction close up", "bedroom environment", "dream atmosphere")
VARIATION_DREAM_LATER = ("eyes opening close up", "hands face reaction", "surreal vision detail", "room detail no sleeping person")
VARIATION_TOPICS = (
    (("провал", "стресс", "паник", "груст", "failed", "stress", "panic", "sad"), ("close reaction", "hands face detail", "different person reaction", "symbolic failure visual")),
    (("карта", "china", "китай", "территор", "map"), ("archival illustration no map", "historical crowd", "location detail", "historical document")),
    (("жертв", "миллион", "погиб", "смерт", "casualt", "million", "death"), ("mourning people", "historical devastation", "destroyed settlement", "somber memorial detail")),
)
VARIATION_PLAIN = (
    ("wide shot", "different angle", "environmental context", "detail shot"),
    ("close detail", "action b roll", "alternate subject", "contextual cutaway"),
    ("visual metaphor", "context shot", "different composition", "different subject"),
)
REPAIR_NOTE = (
    "Use a new subject and a clearly different composition from every previous shot. Do not reuse the same person, "
    "location, map, monument, bed, portrait or camera setup unless the narration explicitly requires continuity."
)

# Concrete props for foreground inserts, and the words that make a query abstract.
PROPS = (
    ("milk carton", ("milk", "молок")),
    ("price tag", ("price tag", "ценник", "цена")),
    ("shopping cart", ("shopping cart", "корзин", "тележ")),
    ("product package", ("package", "packaging", "упаков")),
    ("cardboard box", ("factory", "production line", "производ")),
    ("smartphone", ("phone", "smartphone", "телефон")),
    ("cash money", ("money", "cash", "деньг", "доллар", "грив")),
    ("car", ("car", "автомоб")),
    ("dog", ("dog", "собак")),
    ("cat", ("cat", "кош")),
)
PROP_BAD_PHRASES = (
    "supermarket aisle", "grocery store aisle", "shopping scene", "historical archive", "street scene", "crowd scene",
    "wide shot", "close up", "closeup",
)
PROP_WEAK_WORDS = (
    "scene", "background", "interior", "exterior", "detail", "closeup", "close", "wide", "shot", "aisle", "store",
    "supermarket", "grocery", "shopping", "consumer", "products", "product", "price", "pricing", "concept",
    "illustration", "archive", "historical",
)
PROP_ACTION_WORDS = (
    "customer", "person", "shopper", "looking", "checking", "holding", "taking", "pushing", "comparing", "factory",
    "production", "line",
)
