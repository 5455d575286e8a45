"""The default word lists, labels and phrases of the classification rules.

All needles are lower-case substrings. Operators take these as defaults; callers
may pass their own lists.
"""

# Tone of a caption.
RU_LIFE_LOSS = ("жизн", "жертв", "погиб", "смерт")
RU_LARGE_COUNT = ("миллион", "млн", "тысяч")
RU_LOSS_VERB = ("унесл", "лишил", "потер", "погиб", "умер")
EN_LIFE_LOSS = ("lives", "casualties", "deaths", "died", "killed")
EN_MASS = ("million", "thousand", "mass", "hundreds", "tens of")
EN_LOSS_VERB = ("lost", "claimed", "killed")
VIOLENT_ACTION = ("битв", "сраж", "атак", "штурм", "убил", "взрыв", "резн", "battle", "fight", "attack", "assault", "explosion", "massacre")
MILITARY_ACTION = (
    "арм", "войск", "солдат", "крестьянск", "повстан", "мятеж", "восстан",
    "army", "troops", "soldier", "soldiers", "military", "rebel", "rebellion", "peasant army",
)
TONE_RULES = (
    ("tragic", ("погиб", "погибл", "смерт", "умер", "жертв", "casualt", "death", "killed", "dead", "traged", "died", "lost their lives", "lost lives")),
    ("violent", ("битв", "войн", "убил", "атак", "взрыв", "резн", "battle", "war ", "attack", "explosion", "massacre")),
    ("shocking", ("шок", "вдруг", "неожидан", "оказалось", "ужас", "shock", "suddenly", "unbelievable")),
    ("tense", ("стресс", "паник", "опас", "угроз", "страх", "напряж", "stress", "panic", "danger", "fear")),
    ("mysterious", ("сон", "видение", "галлюцин", "тайн", "мист", "dream", "vision", "myster", "hallucin")),
    ("religious", ("иисус", "христ", "бог", "религи", "церк", "jesus", "christ", "god", "relig")),
    ("funny", ("смеш", "лол", "прикол", "мем", "ахах", "funny", "lol", "meme", "joke")),
    ("absurd", ("абсурд", "безум", "дико", "crazy", "absurd", "ridiculous")),
    ("victorious", ("побед", "триумф", "выиграл", "victor", "triumph", "won")),
    ("positive", ("счаст", "радост", "успех", "любов", "happy", "joy", "success", "love")),
    ("negative", ("провал", "проиграл", "разочар", "груст", "failed", "failure", "sad", "disappoint")),
    ("emotional", ("эмоц", "плак", "слез", "cry", "emotional", "tears")),
    ("informational", ("согласно", "статист", "факт", "данн", "according", "statistics", "fact", "data")),
)
TONES = (
    "neutral", "informational", "positive", "negative", "tragic", "tense", "shocking", "absurd", "funny",
    "victorious", "mysterious", "religious", "violent", "emotional",
)
DARK_TONES = ("tragic", "negative", "violent", "tense", "shocking")
LIGHT_TONES = ("positive", "funny", "victorious", "absurd")
TONE_HINTS = {
    "tragic": "somber aftermath destruction mourning",
    "violent": "conflict destruction tense",
    "negative": "somber disappointed dark",
    "tense": "tense anxious dramatic",
    "shocking": "dramatic shocking serious",
    "mysterious": "mysterious surreal atmospheric",
    "religious": "religious sacred painting",
    "positive": "uplifting hopeful",
    "victorious": "victory triumphant",
    "funny": "funny reaction",
    "emotional": "emotional expressive",
}

# Mood of a whole plan.
MOOD_RULES = (
    ("dark", ("страш", "ужас", "убий", "ноч", "тайн", "шок")),
    ("sad", ("груст", "расстро", "провал", "потер", "расстал")),
    ("energetic", ("деньг", "успех", "выигр", "миллион", "топ", "быстро")),
)

# Visual intent of a caption.
MEME_STEMS = ("вдруг", "и тут", "прикол", "шок", "жесть", "серьезно", "неожидан", "пиздец", "лол", "смеш", "офиг", "охрен", "что за")
VIDEO_STEMS = ("идет", "идут", "беж", "летит", "едет", "горит", "взрыв", "толп", "марш", "атак", "движ", "сраж")
HISTORY_STEMS = (
    "истор", "восстан", "импер", "династ", "войн", "арм", "солдат", "битв", "револю",
    "xix", "xviii", "тайпин", "сюцюан", "крестьян",
)
DRAMATIC_STEMS = ("вдруг", "шок", "галлюцин", "видение", "убит", "погиб", "битв", "войн", "восстан", "огонь", "взрыв")
PULLBACK_STEMS = ("итог", "в итоге", "миллион", "погиб", "закончил", "после", "последств")

# Story context.
COUNTRY_RULES = (
    ("China Chinese", ("китай", "китайск")),
    ("Taiping Rebellion", ("тайпин",)),
    ("Hong Xiuquan", ("сюцюан", "хун сю", "hong xiu")),
    ("Soviet Union Soviet", ("ссср", "советск")),
    ("Ukraine Ukrainian", ("украин",)),
    ("Russia Russian", ("росси", "русск")),
    ("United States American", ("америк", "сша")),
    ("Germany German", ("герман", "немец")),
    ("Japan Japanese", ("япон",)),
    ("France French", ("франц",)),
    ("Britain British", ("британ", "англи")),
)
HINT_RULES = (
    ("civil service examination student", ("экзам", "госэкзам", "тест")),
    ("stressed disappointed person", ("стресс", "нерв", "расстро", "груст", "провал")),
    ("government official civil service", ("чиновник", "служб")),
    ("sleeping person dream", ("сон", "спал", "снилось")),
    ("surreal vision revelation", ("галлюцин", "видение", "озарен")),
    ("Christian religious imagery", ("иисус", "христ", "религи", "бог")),
    ("historical soldiers peasants army marching", ("арм", "солдат", "войск", "крестьян")),
    ("historical rebellion battle crowd", ("восстан", "бунт", "битв", "револю")),
    ("money finance counting cash", ("деньг", "цена", "миллион", "тысяч")),
    ("person using smartphone", ("телефон", "сообщен", "звон")),
    ("car driving road", ("машин", "авто")),
    ("video creator computer camera", ("компьют", "ютуб", "видео")),
)
HONG = ("сюцюан", "хун сю", "hong xiu")
WORLD_WAR_ONE = ("первая миров", "первой миров", "world war i", "first world war")
CHINA = ("китай", "китайск", "china", "chinese")
QING = ("династия цин", "династии цин", "qing dynasty")
TAIPING_STORY = ("тайпин", "сюцюан", "taiping", "hong xiu")
CHRISTIAN = ("иисус", "христ", "jesus", "christ")
ARMY_ACTION = ("арм", "войск", "солдат", "крестьян")
# Century markers, most of them Russian; the order is that of the era test.
ERA_PATTERNS = (
    ("19th century", r"\b18\d{2}\b|\b19\s*(?:-|‑)?\s*(?:й|ый)?\s*век|\bxix\b"),
    ("18th century", r"\b17\d{2}\b|\b18\s*(?:-|‑)?\s*(?:й|ый)?\s*век|\bxviii\b"),
    ("20th century", r"\b19\d{2}\b|\b20\s*(?:-|‑)?\s*(?:й|ый)?\s*век|\bxx\b"),
    ("21st century modern", r"\b20\d{2}\b|\b21\s*(?:-|‑)?\s*(?:й|ый)?\s*век|\bxxi\b"),
)
CENTURY_PATTERNS = (
    (19, r"\b18\d{2}\b|\b19th[- ]century\b|\bxix\b"),
    (20, r"\b19\d{2}\b|\b20th[- ]century\b|\bxx\b"),
    (21, r"\b20\d{2}\b|\b21st[- ]century\b|\bxxi\b"),
    (18, r"\b17\d{2}\b|\b18th[- ]century\b|\bxviii\b"),
)

# Coarse tags of English queries.
QUERY_TAGS = (
    ("china", ("china", "chinese", "qing", "taiping")),
    ("religion", ("jesus", "christ", "christian", "biblical", "religious", "church", "sacred")),
    ("army", ("army", "soldier", "soldiers", "military", "rebel", "rebellion", "peasants", "battle", "troops")),
    ("emotion", ("stress", "stressed", "anxious", "sad", "upset", "disappointed", "panic", "crying")),
    ("vision", ("vision", "dream", "surreal", "hallucination", "revelation", "mystical")),
    ("exam", ("exam", "examination", "student", "civil service")),
    ("war", ("war", "wwi", "world war", "trench", "battlefield")),
    ("money", ("money", "cash", "finance", "currency")),
)
ACTION_VERBS = (
    "taking", "holding", "checking", "pushing", "putting", "moving", "reading", "using", "paying", "counting",
    "walking", "running", "interacting", "comparing", "driving", "opening", "packing", "reacting", "looking",
    "working", "eating", "drinking", "writing", "talking", "playing",
)

# Role of a beat in the edit.
ROLE_CASUALTY = ("погиб", "жертв", "смерт", "миллион", "унесл", "casualt", "killed", "dead", "death", "million lives")
ROLE_BATTLE = ("битв", "атак", "сраж", "бой", "взрыв", "battle", "attack", "fight", "explosion")
ROLE_ARMY = ("арм", "войск", "солдат", "крестьян", "повстан", "восстан", "army", "troops", "soldier", "rebel", "rebellion", "peasant")
ROLE_AWAKEN = ("проснул", "просып", "разбуд", "очнул", "woke", "wake up", "awoke")
ROLE_RELIGIOUS = ("иисус", "христ", "бог", "jesus", "christ", "god")
ROLE_BELIEF = ("брат", "уверен", "считал", "поверил", "решил", "brother", "believed", "convinced", "certain")
ROLE_DREAM = ("сон", "снилось", "видение", "галлюцин", "dream", "vision", "hallucin")
ROLE_REACTION = ("стресс", "паник", "провал", "разочар", "груст", "нерв", "stress", "panic", "failed", "failure", "disappoint", "anxious")

# Reaction stickers: strength, needles, prompt.
REACTION_RULES = (
    (5, ("обман", "хитр", "трюк", "скрыва", "не замет", "специально", "нагло", "secret trick", "deceiv", "sneaky"), "skeptical suspicious side-eye reaction emoji sticker"),
    (5, ("шок", "неожидан", "оказалось", "вдруг", "офиг", "охуел", "жесть", "shock", "suddenly", "unbelievable"), "shocked disbelief wide-eyes reaction emoji sticker"),
    (5, ("смеш", "ахах", "лол", "прикол", "угар", "funny", "lol", "joke"), "laughing crying funny reaction emoji sticker"),
    (4, ("почему", "странно", "непонят", "сомнева", "серьезно", "серьёзно", "confus", "weird", "why", "seriously"), "confused skeptical thinking reaction emoji sticker"),
    (4, ("бесит", "злит", "достал", "наглость", "angry", "annoy", "furious"), "angry annoyed reaction emoji sticker"),
    (4, ("груст", "обид", "печаль", "sad", "disappointed"), "sad disappointed reaction emoji sticker"),
)
REACTION_FAMILIES = (
    ("money", ("money", "price", "cash", "expensive", "dollar", "coin")),
    ("skeptical", ("skeptical", "suspicious", "side eye", "doubt")),
    ("confused", ("confused", "thinking", "puzzled", "why")),
    ("shocked", ("shocked", "surprised", "wide eyes", "wtf")),
    ("laugh", ("laugh", "funny", "lol", "crying laughing")),
    ("sad", ("sad", "crying", "disappointed")),
    ("angry", ("angry", "mad", "furious")),
    ("happy", ("happy", "heart eyes", "love", "smiling")),
)

# Names in candidate metadata.
EVENT_NAMES = (
    ("taiping rebellion", ("taiping rebellion", "taiping")),
    ("world war i", ("world war i", "first world war", "wwi", "1914-1918", "1914–1918")),
    ("world war ii", ("world war ii", "second world war", "wwii", "1939-1945", "1939–1945")),
    ("american civil war", ("american civil war", "u.s. civil war", "us civil war")),
    ("crimean war", ("crimean war",)),
    ("vietnam war", ("vietnam war",)),
    ("korean war", ("korean war",)),
    ("napoleonic wars", ("napoleonic war", "napoleonic wars")),
    ("russian civil war", ("russian civil war",)),
)
COUNTRY_NAMES = (
    ("china", ("china", "chinese", "qing", "китай", "цин")),
    ("russia", ("russia", "russian", "росси", "русск")),
    ("ukraine", ("ukraine", "ukrainian", "украин")),
    ("germany", ("germany", "german", "герман", "немец")),
    ("france", ("france", "french", "франц")),
    ("britain", ("britain", "british", "england", "english", "британ", "англи")),
    ("japan", ("japan", "japanese", "япон")),
    ("united states", ("united states", "american", "u.s.", "usa", "сша")),
    ("vietnam", ("vietnam", "vietnamese")),
    ("korea", ("korea", "korean")),
)

# Media quality and judging.
BAD_TITLE_TERMS = (
    "screenshot", "screen shot", "website", "webpage", "logo", "watermark", "poster", "banner",
    "sign", "signboard", "plaque", "label", "caption", "text only", "diagram", "infographic",
)
RED_FLAGS = (
    "wrong person", "wrong event", "wrong war", "wrong century", "wrong country", "wrong period",
    "different war", "different conflict", "unrelated conflict", "anachron",
    "modern substitute", "modern-day", "modern setting",
)
BANNED_QUERY_TERMS = (
    "abstract", "concept", "metaphor", "animation", "background", "vj",
    "earth", "planet", "revolution", "aesthetic", "symbolic",
)

# Sound cues: needle pattern over the lower-cased caption.
CUE_IMPACT = r"\b(но|вдруг|резко|однако|и тут|но тут)\b"
CUE_PHONE = r"(телефон|сообщени|уведомлен|звонок)"
CUE_SHOCK = r"(страш|шок|ужас|неожидан|пиздец)"
CUE_MONEY = r"(деньг|цена|дорог|дешев|миллион|тысяч)"

# Enumerations of a plan.
VISUAL_MODES = ("auto", "image", "video", "meme")
SOURCE_MODES = ("auto", "historical_archive", "stock_video", "meme_library", "generic_image")
MOTION_PRESETS = ("none", "micro_push", "slow_push", "dramatic_push", "pull_back", "reveal_left", "reveal_right")
