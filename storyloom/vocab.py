"""Word lists, patterns and weights that results depend on, whole and in their own order. KEYWORDS is the default of a parameter."""

# Categories in order of declaration, the default, aliases, and those kept out of top stories.
CATEGORIES = ("top_stories", "world", "politics", "business", "technology", "science", "health", "sports", "entertainment", "lifestyle", "environment")
DEFAULT_CATEGORY = "world"
CATEGORY_ALIASES = {
    "tech": "technology", "finance": "business", "medical": "health", "international": "world", "climate": "environment", "government": "politics",
    "general": "world", "us": "world", "uk": "world", "europe": "world", "australia": "world", "asia": "world",
}
SOFT_CATEGORIES = ("lifestyle", "entertainment")

# Title patterns of lifestyle pieces.
LIFESTYLE = (
    r"\bbest\b.*\b(?:for|of|to|in)\b", r"\btop\s+\d+\b", r"\b\d+\s+best\b", r"\bhere\s+(?:are|is)\s+\d+\+?\b", r"\breviewed?\b", r"\btested\b", r"\b(?:tried|we)\s+(?:and\s+)?tested\b",
    r"\bbest\s+(?:buys?|picks?|choices?)\b", r"\b(?:our|my)\s+(?:top\s+)?picks?\b", r"\bwhat\s+to\s+(?:buy|get|wear|use)\b", r"\b(?:buyer|shopping)\s*(?:'?s?)?\s+guide\b",
    r"\bguide\s+to\b", r"\bhow\s+to\b", r"\btips?\s+(?:for|on|to)\b", r"\badvice\b", r"\bhere'?s?\s+(?:what|how|why)\b", r"\byou\s+should\s+(?:too|also)\b",
    r"\bwe\s+stopped\s+using\b", r"\bwhy\s+(?:i|we)\s+(?:stopped|switched|quit)\b", r"\brecipes?\b", r"\bcooking\s+(?:tip|hack|trick)\b", r"\bkitchen\s+(?:tip|hack|trick)\b", r"\b(?:aluminum\s+)?foil\s+(?:for|in)\s+cooking\b",
    r"\bdeals?\b.*\b(?:on|for)\b", r"\bbargain\b", r"\bgift\s+(?:guide|ideas?)\b", r"\b\d+\+?\s+(?:thoughtful\s+)?gifts?\b", r"\bmother'?s?\s+day\b", r"\bfather'?s?\s+day\b",
    r"\bvalentine'?s?\b", r"\bholiday\s+(?:gift|idea|tip)\b", r"\bshe'?ll\s+love\b", r"\bhe'?ll\s+love\b",
)

# URL sections, first match wins.
SECTIONS = (
    ("lifestyle", ("/lifestyle/", "/living/", "/home/", "/food/", "/travel/", "/shopping/", "/style/", "/fashion/", "/beauty/", "/wellness/", "/money/consumer/")),
    ("entertainment", ("/entertainment/", "/movies/", "/music/", "/celebrity/", "/film/", "/showbiz/", "/arts/")),
    ("sports", ("/sports/", "/sport/", "espn.com", "/nba/", "/nfl/", "/mlb/", "/cricket/", "/football/", "/soccer/")),
    ("politics", ("/politics/", "/political/", "/elections/", "/government/")),
    ("technology", ("/tech/", "/technology/", "techcrunch.com", "wired.com", "/gadgets/")),
    ("business", ("/business/", "/markets/", "/finance/", "/economy/", "bloomberg.com", "wsj.com")),
    ("environment", ("/environment/", "/climate/", "/green/")),
    ("health", ("/health/", "/medical/", "/wellness/")),
)

# Scored keywords (category, weight, words): the default of a parameter; the first category of equals wins.
KEYWORDS = (
    ("politics", 3, ("president", "prime minister", "parliament", "congress", "senate", "white house", "government", "minister", "ministry", "election", "vote", "campaign", "legislation", "supreme court", "federal", "state department", "defense department", "defence")),
    ("politics", 2, ("political", "politician", "policy", "law", "bill", "regulation", "governor", "mayor", "senator", "representative", "diplomat", "cabinet", "administration")),
    ("politics", 1, ("voter", "ballot", "partisan", "bipartisan")),
    ("sports", 3, ("f1", "formula 1", "nba", "nfl", "mlb", "nhl", "soccer", "football", "basketball", "baseball", "hockey", "tennis", "golf", "cricket", "olympics", "world cup", "premier league", "champions league", "rugby", "boxing", "mma", "ufc")),
    ("sports", 2, ("sport", "game", "team", "player", "coach", "championship", "league", "match", "tournament", "season", "playoff", "athlete", "medal")),
    ("sports", 1, ("score", "goal", "point", "defeat", "victory")),
    ("technology", 3, ("apple", "microsoft", "google", "facebook", "amazon", "netflix", "tesla", "startup", "silicon valley", "artificial intelligence", "machine learning", "openai", "chatgpt", "iphone", "android", "cryptocurrency", "bitcoin")),
    ("technology", 2, ("tech", "software", "app", "digital", "cyber", "ai", "computer", "data", "internet", "online", "website", "platform", "gadget", "smartphone")),
    ("technology", 1, ("algorithm", "code", "programming", "update")),
    ("science", 3, ("nasa", "nobel", "research paper", "scientific study", "climate change", "spacex", "mars", "moon landing")),
    ("science", 2, ("science", "research", "study", "scientist", "discovery", "experiment", "physics", "chemistry", "biology", "space", "astronomy", "genetic")),
    ("science", 1, ("theory", "hypothesis", "laboratory")),
    ("business", 3, ("wall street", "stock market", "nasdaq", "dow jones", "federal reserve", "real estate", "property market", "ipo", "merger", "acquisition")),
    ("business", 2, ("business", "economy", "market", "stock", "finance", "company", "ceo", "revenue", "profit", "trade", "investment", "property", "housing", "mortgage")),
    ("business", 1, ("earnings", "quarter", "sales")),
    ("world", 3, ("united nations", "nato", "european union", "g7", "g20", "war", "conflict", "israel", "gaza", "ukraine", "russia", "china", "immigration", "refugee", "terrorism", "attack", "bombing", "hostage", "sanctions")),
    ("world", 2, ("international", "foreign policy", "embassy", "border crisis", "peace deal", "ceasefire", "invasion", "asylum", "deportation", "coup", "genocide", "humanitarian crisis", "peacekeeping")),
    ("world", 1, ("diplomatic", "treaty", "ambassador")),
    ("health", 3, ("covid", "pandemic", "fda", "cdc", "who", "coronavirus", "cancer", "tumor", "tumour", "outbreak", "epidemic")),
    ("health", 2, ("health", "medical", "doctor", "hospital", "disease", "vaccine", "patient", "treatment", "drug", "medicine", "surgery", "mental health", "obesity")),
    ("health", 1, ("symptom", "diagnosis", "healthcare", "clinic")),
    ("entertainment", 3, ("oscar", "grammy", "emmy", "tony award", "golden globe", "cannes", "sundance", "hollywood", "broadway", "box office", "bafta")),
    ("entertainment", 2, ("actor", "actress", "film", "movie", "director", "celebrity", "star", "album", "concert", "music", "band", "singer", "artist", "show", "series", "netflix", "disney", "streaming", "premiere", "festival", "tv show")),
    ("entertainment", 1, ("entertainment", "performance", "role", "cast")),
    ("environment", 3, ("climate crisis", "global warming", "greenhouse gas", "carbon emissions", "renewable energy", "deforestation", "extinction", "biodiversity")),
    ("environment", 2, ("environment", "pollution", "sustainability", "conservation", "wildlife", "recycling", "fossil fuel", "solar", "wind power", "electric vehicle")),
    ("environment", 1, ("eco", "green", "organic")),
)
LIGHT_KEYWORDS = (
    ("technology", ("tech", "software", "app", "ai", "crypto", "startup")),
    ("business", ("business", "market", "stock", "economy", "trade")),
    ("sports", ("sport", "football", "basketball", "soccer", "nfl", "nba")),
    ("science", ("science", "research", "study", "nasa", "space")),
    ("health", ("health", "medical", "vaccine", "disease", "hospital")),
)

# Promotional content.
PROMO_PHRASES = ("sponsored content", "sponsored post", "paid content", "paid partnership", "advertisement", "brought to you by", "in partnership with", "presented by", "promotional content", "advertorial", "native advertising")
PROMO_PATTERNS = (
    r"\d+\s+best.*(?:deals|products|buys|items)", r"(?:best|top)\s+\d+.*(?:deals|to shop|to buy)", r"amazon\s+deals", r"shop\s+(?:these|this|now)", r"(?:on sale|discounts?|save \$)", r"price drop", r"limited time offer",
    r"buy now", r"check out these", r"you need to (?:buy|shop)", r"must-have products", r"\d+\s+(?:products|items).*(?:you can|to).*(?:buy|shop|get)",
    r"\d+\s+(?:of the|the)?.*products.*(?:you can|to).*(?:buy|shop|get)", r"\d+\s+.*products.*(?:buy|shop).*(?:amazon|walmart|target)", r"products worth buying", r"items on sale", r"things to (?:buy|shop)",
    r"\d+\s+.*(?:useful|essential|must-have).*products", r"\d+.*travel products.*(?:buy|amazon)", r"gift guide", r"best gifts for", r"you won't believe.*(?:deal|price)", r"products you can buy",
)
PROMO_URLS = ("/deals/", "/shopping/", "/products/", "/coupons/", "/reviews/best-", "/affiliate")
DINING = (
    "restaurant", "dining", "menu", "cafe", "bistro", "bar", "pub", "eatery", "upscale", "fine dining", "michelin", "chef", "culinary", "wine list", "tasting menu", "reservation", "dine", "brunch", "scenic", "luxur", "exquisite",
    "perfect for", "ideal for", "nestled", "charm", "atmosphere", "ambiance", "intimate", "cozy", "elegant", "sophisticated", "award-winning", "food guide", "where to eat", "best restaurants",
)
DINING_URLS = ("/lifestyle/", "/food/", "/dining/", "/restaurants/", "/travel/", "/good-food/")
#: URLs of restaurant guides, and the title words that make a piece there news all the same.
VENUE_URLS = ("/good-food", "/best-restaurant", "/food-drink", "/venue", "/eating-out")
NEWS_WORDS = ("says", "announces", "reports", "confirms", "claims", "accuses", "reveals", "attack", "fire", "death", "killed", "injured", "arrested", "charged", "verdict", "found")
PROMO_LIGHT = ("sponsored", "advertisement", "promoted", "partner content", "buy now", "shop now", "limited time", "exclusive offer", "click here", "subscribe now", "sign up", "free trial")

# Stop words and verbs that story fingerprints leave out.
STOP_FINGERPRINT = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "are", "been", "be", "have", "has", "had", "do", "does", "did", "will", "would", "should", "could", "may", "might", "must", "can", "this", "that", "these", "those", "says", "after", "over", "about", "into", "through", "during", "before", "under", "between", "out", "against", "among", "throughout", "up", "down")
GENERIC_VERBS = ("announces", "unveils", "reveals", "confirms", "denies", "reports", "claims", "stated", "tells", "speaks", "discusses", "says", "told")
STOP_TITLE = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "are", "been", "be", "have", "has", "had", "says", "said", "reports", "after")
COUNTRIES = ("US", "USA", "UK", "China", "Japan", "Russia", "France", "Germany", "India", "Canada", "Australia", "Brazil", "Mexico", "Italy", "Spain")

# Event signatures.
ACTIONS = (
    "announced", "declared", "stated", "confirmed", "denied", "proposed", "approved", "rejected", "passed", "signed", "vetoed", "resigned", "appointed", "elected", "won", "lost", "defeated", "nominated",
    "attacked", "bombed", "fired", "shot", "killed", "injured", "died", "struck", "hit", "destroyed", "damaged", "evacuated", "fled",
    "acquired", "merged", "bought", "sold", "invested", "raised", "cut", "laid off", "hired", "bankrupt", "profitable", "reported",
    "arrested", "charged", "convicted", "sentenced", "acquitted", "indicted", "investigated", "accused", "pleaded", "confessed",
    "devastated", "flooded", "burned", "collapsed", "crashed", "derailed", "exploded", "leaked", "spilled",
    "diagnosed", "treated", "cured", "vaccinated", "infected", "recovered", "hospitalized", "tested",
    "scored", "beat", "qualified", "eliminated", "advanced", "retired", "suspended", "happened", "occurred", "took place", "broke out", "erupted",
)
EVENT_TYPES = (
    ("earthquake", ("earthquake", "quake", "tremor", "aftershock")), ("hurricane", ("hurricane", "tropical storm", "cyclone", "typhoon")), ("flood", ("flood", "flooding", "flash flood")), ("fire", ("fire", "wildfire", "bushfire", "forest fire")), ("tornado", ("tornado", "twister", "funnel cloud")),
    ("war", ("war", "invasion", "occupation", "ceasefire")), ("terrorism", ("terrorist", "bombing", "attack", "explosion")), ("shooting", ("shooting", "gunfire", "mass shooting")), ("protest", ("protest", "demonstration", "riot", "unrest")),
    ("election", ("election", "vote", "ballot", "campaign", "candidate")), ("government", ("government", "parliament", "congress", "senate")), ("policy", ("policy", "law", "bill", "legislation", "reform")),
    ("merger", ("merger", "acquisition", "takeover", "buyout")), ("bankruptcy", ("bankruptcy", "insolvent", "liquidation")), ("earnings", ("earnings", "profit", "revenue", "quarterly")),
    ("launch", ("launch", "release", "unveiled", "announced")), ("hack", ("hack", "breach", "cyberattack", "data breach")), ("recall", ("recall", "defect", "safety issue")),
    ("pandemic", ("pandemic", "epidemic", "outbreak", "virus")), ("vaccine", ("vaccine", "vaccination", "immunization")), ("championship", ("championship", "final", "tournament", "league")), ("record", ("record", "historic", "unprecedented", "first")),
)
SCALES = (("breaking", ("breaking", "urgent", "emergency", "crisis")), ("massive", ("massive", "huge", "major", "significant", "substantial")), ("historic", ("historic", "historical", "unprecedented", "first time")), ("deadly", ("deadly", "fatal", "killed", "died", "casualties")), ("widespread", ("widespread", "nationwide", "global", "international")))
TEMPORAL = (("current", ("now", "currently", "ongoing", "continuing", "live")), ("recent", ("just", "recently", "latest", "new", "fresh")), ("future", ("planned", "scheduled", "expected", "anticipated")), ("past", ("previously", "earlier", "ago", "yesterday")))

# Topics that can't belong to one story.
TOPICS = (
    ("crime", ("stab", "murder", "arrest", "crime", "police", "shot", "kill", "assault", "robbery")), ("health", ("doctor", "hospital", "medical", "health", "vaccine", "patient", "surgery", "dentist", "clinic")),
    ("sports", ("team", "win", "championship", "game", "player", "score", "league", "match", "tournament")), ("politics", ("election", "vote", "senator", "president", "congress", "legislation", "governor", "campaign")),
    ("business", ("stock", "market", "company", "ceo", "profit", "investment", "earnings", "trade")), ("weather", ("hurricane", "storm", "flood", "tornado", "weather", "rain", "snow", "drought")),
    ("disaster", ("earthquake", "tsunami", "disaster", "emergency", "evacuation", "damage", "collapse")),
)

# Generated text: refusals, and what is cut from summaries and headlines.
REFUSALS = ("i cannot", "cannot create", "cannot provide", "insufficient", "would need", "please provide", "unable to", "not possible", "requires additional", "incomplete information", "lacks essential")
REFUSALS_LIVE = (*REFUSALS, "based on the provided information", "source contains only", "null content", "no actual article", "guidelines specify")
SUMMARY_STARTS = (
    r"^Here'?s?\s+(?:a\s+)?(?:concise|comprehensive|authoritative|brief|factual|neutral)[\s,]+(?:authoritative\s+)?summary[:\s]*", r"^(?:COMPREHENSIVE\s+)?NEWS\s+SUMMARY[:\s]*(?:[A-Za-z\s]+[:\s]*)?", r"^Summary[:\s]*",
    r"^(?:Here\s+is\s+)?(?:The\s+)?(?:a\s+)?(?:news\s+)?summary[:\s]*", r"^Based\s+on\s+(?:the\s+)?(?:provided\s+)?(?:articles?|sources?|information)[,:\s]*",
    r"^(?:According\s+to\s+)?(?:the\s+)?(?:multiple\s+)?sources?[,:\s]*here'?s?\s+(?:what\s+we\s+know|a\s+summary)[:\s]*",
)
SUMMARY_ENDS = (r"[.\s]+The\s+summary\s+(?:provides|offers|gives|presents)[\s\S]*$", r"[.\s]+This\s+(?:summary|overview)\s+(?:provides|offers|gives|presents|maintains|covers)[\s\S]*$", r"[.\s]+(?:I'?ve\s+)?(?:maintained|ensured|kept)\s+(?:a\s+)?neutral\s+tone[\s\S]*$", r"[.\s]+(?:The\s+)?(?:above\s+)?summary\s+is\s+(?:factual|neutral|comprehensive)[\s\S]*$")
HEADLINE_CUTS = ("rationale:", "reason:", "explanation:", "note:", "update reason:")
HEADLINE_STARTS = (r"^Updated\s+headline[:\s]*", r"^New\s+headline[:\s]*", r"^Headline[:\s]*", r"^Suggested[:\s]*")
HEADLINE_TAGS = (r"\s*\|\s*(?:Special\s+Report|BREAKING|Live|Update|Analysis|Opinion|Exclusive)$", r"\s*-\s*(?:Live|Update|Breaking)$")

# Scoring weights.
TITLE_WEIGHTS = {"keywords": 0.40, "proper": 0.40, "substring": 0.15, "jaccard": 0.05}
AFFINITY = {"view": 1, "like": 3, "share": 4, "save": 5}

# Words that keyword retrieval leaves out: of documents, and of queries.
STOP_RETRIEVAL = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "are", "were", "be", "have", "has", "had", "do", "does", "did", "will", "would")
STOP_QUERY = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "are", "were", "be")

# Entity links: types that fit a kind of mention, and words around one that speak for a person or a place.
LINK_TYPES = {"PERSON": ("person",), "LOCATION": ("city", "state", "country", "geographical feature"), "ORGANIZATION": ("organization", "company", "business", "newspaper", "enterprise"), "GPE": ("city", "state", "country", "geographical feature")}
PERSON_CLUES = ("president", "minister", "director", "actor", "author", "scientist")
PLACE_CLUES = ("capital", "located", "based", "headquarters", "city", "country")

# Weights of pair scores.
RULE_WEIGHTS = {"embedding_similarity": 0.4, "entity_overlap_jaccard": 0.2, "temporal_proximity": 0.15, "event_signature_similarity": 0.1, "geographic_proximity": 0.1, "wikidata_consistency": 0.05}
FACTOR_WEIGHTS = {"cosine": 0.55, "entities": 0.20, "title": 0.10, "time": 0.10, "place": 0.05}

# Headlines for checking rules on tables whose texts hold no newsroom words.
HEADLINES = (
    "President announces new climate policy in Washington", "Senate approves bill on housing market reform", "Earthquake struck Japan killing dozens, officials confirmed", "Hurricane damaged homes across Florida coast", "Best laptops for students in 2024",
    "How to cook rice at home", "Apple unveiled new iPhone at launch event", "Stock market falls as inflation data released", "Team won championship after tense final match", "Doctor charged after hospital patient died",
    "Police arrested suspect after shooting in Texas", "Sponsored content: amazing discounts on shoes", "Top 10 gifts you need to buy now", "NASA scientists announced discovery on Mars", "Ukraine and Russia agree ceasefire talks",
    "Cafe Bistro Luna", "Google invested in artificial intelligence startup", "Wildfire destroyed forest near Sydney, Australia", "New vaccine approved for outbreak in Brazil", "Actor won Oscar for historic film role",
    "Global warming threatens wildlife in Iceland", "Company merged with rival in major acquisition", "Election vote counted in Kazakhstan", "Flood evacuated thousands in Germany", "Recipe: kitchen tricks for busy families",
    "Cyber breach leaked data of US government", "Football league suspended player after match", "Protest erupted in France over pension law", "Bank reported record quarterly profit", "United Nations condemned attack on embassy",
)
# What follows them in turn, so that titles differ.
HEADLINE_TAILS = ("", "on Monday", "in Kazakhstan", "as markets fell", "and here is why", "after Senate vote", "for the second time")
