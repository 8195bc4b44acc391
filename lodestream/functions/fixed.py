"""Fixed values that results depend on: keyword lists, patterns, templates. Plain text, in their natural order."""

INTENTS = {
    "related": ["related etf", "similar etf", "alternative etf", "profile similar", "cluster", "hidden twin", "home bias", "相似", "替代", "同類", "叢集", "聚類", "隱藏雙生", "本地偏誤"],
    "news": ["news", "headline", "event", "story", "related ticker", "find ticker", "which ticker", "資訊", "新聞", "事件", "相關代號", "找代號"],
    "feature": ["feature", "features", "overview", "summary", "about this etf", "tell me about", "characteristic", "profile", "介紹", "概覽", "重點", "特點", "這隻etf"],
    "fee": ["fee", "fees", "charge", "charges", "expense ratio", "ongoing charges", "management fee", "費用", "收費", "管理費", "開支比率"],
    "dividend": ["dividend", "distribution", "yield", "派息", "股息", "分派"],
    "tracking": ["track", "tracked", "index", "benchmark", "objective", "追蹤", "指數", "目標"],
    "risk": ["risk", "risks", "volatility", "drawdown", "downside", "風險", "波動", "回撤", "下行"],
    "recommendation": ["recommend", "suggest", "alternative", "which etf", "buy", "switch", "allocate", "rebalance", "推薦", "建議", "替代", "買", "換", "配置", "再平衡"],
}

THEMES = {
    "oil": ["oil", "crude", "wti", "brent", "石油", "原油", "能源"],
    "gold": ["gold", "bullion", "黃金"],
    "china_tech": ["china tech", "chinese tech", "中國科技", "科技股", "科網", "internet", "platform"],
    "dividend": ["dividend", "yield", "income", "派息", "股息", "收益"],
    "bond": ["bond", "fixed income", "treasury", "債券", "債", "固定收益"],
    "money_market": ["money market", "cash management", "貨幣市場", "現金管理"],
}

QUERY_REWRITES = [
    (r"\bfomc\b|\bfed\b|\bfederal reserve\b", "fomc"),
    (r"\brate hikes?\b|\bhigher rates?\b|\bmonetary tightening\b", "interest rate hike"),
    (r"\brate cuts?\b|\beasing cycle\b", "interest rate cut"),
    (r"\bnonfarm payrolls?\b|\bus labor report\b", "us labor data"),
    (r"\bhang seng tech\b|\bhk tech\b", "hong kong technology equity"),
    (r"\bbitcoin\b|\bbtc\b", "bitcoin"),
    (r"\boil\b|\bcrude\b", "oil commodity"),
    (r"\bmoney market\b|\bcash management\b", "money market"),
]

RISK_HINTS = ["risk factors", "key risks", "risk profile", "investment risks", "risk"]
RISK_PATTERNS = ["subject to", "may be adversely", "volatility", "tracking error", "concentration risk", "liquidity risk", "currency risk", "credit risk", "interest rate risk", "counterparty risk"]
NOISE_PHRASES = [
    "quick facts", "stock code", "trading lot size", "manager:", "trustee", "registrar", "counterparty", "comply with the following provisions",
    "the following provisions", "subject to paragraphs", "otc", "over-the-counter", "appendix", "schedule", "table",
]

RISK_KEYWORDS = {
    "interest_rate": ["interest rate", "rate risk", "monetary policy", "hkma", "federal reserve", "fed funds", "yield", "duration risk"],
    "commodity": ["commodity", "oil", "crude", "gold", "silver", "metals", "natural gas", "energy price", "commodity volatility"],
    "equity_market_hk": ["hong kong equity", "hang seng", "main board", "equity market", "market selloff", "valuation risk"],
    "equity_fundamental": ["earnings", "earnings growth", "earnings revision", "revenue", "sales growth", "profit margin", "guidance cut", "valuation multiple", "price to earnings", "p/e"],
    "region_risk": [
        "apac", "amer", "emea", "asean", "north america", "latin america", "europe", "middle east", "africa", "japan", "korea", "taiwan", "india",
        "emerging market", "frontier market", "regional risk", "cross border risk",
    ],
    "tech_sector": ["technology", "tech sector", "ai", "artificial intelligence", "semiconductor", "chip", "hardware", "software", "cloud computing", "cybersecurity", "data center"],
    "us_labor_macro": ["nonfarm payroll", "unemployment", "labor market", "wage growth", "jobs report"],
    "us_specific_risk": ["us recession", "debt ceiling", "treasury yield", "fomc", "federal reserve", "fiscal cliff", "government shutdown", "us policy risk"],
    "china_specific_risk": [
        "china", "prc", "mainland", "pbo c", "pboc", "property sector", "local government debt", "geopolitical tension", "regulatory crackdown", "china policy", "capital control",
    ],
    "money_market": ["money market", "treasury bill", "t-bill", "commercial paper", "certificate of deposit", "repo", "liquidity buffer", "cash equivalent", "short duration", "short term rate"],
    "style_factor": [
        "value", "quality", "high dividend", "growth", "large cap", "mid cap", "small cap", "passive", "active", "esg", "sustainable", "leverage", "factor", "low volatility",
        "momentum", "size factor",
    ],
    "fx": ["foreign exchange", "currency risk", "fx risk", "exchange rate"],
    "credit_liquidity": ["credit risk", "liquidity risk", "counterparty", "default risk"],
    "tracking_error": ["tracking error", "tracking difference", "index tracking"],
    "concentration": ["concentration risk", "single issuer", "sector concentration"],
    "derivatives": ["derivatives", "swap", "futures", "options", "synthetic"],
}
COMPONENT_KEYWORDS = {
    "benchmark_index": ["benchmark", "index", "tracked", "tracking", "index provider"],
    "asset_class": ["asset class", "equity", "bond", "money market", "commodity", "fixed income"],
    "geographic_focus": ["geographic focus", "hong kong", "china", "asia", "us", "global", "emerging market"],
    "replication_method": ["full replication", "representative sampling", "synthetic", "physical"],
    "strategy": ["investment objective", "investment strategy", "objective", "portfolio", "constituent"],
    "distribution": ["distribution policy", "dividend policy"],
}

QUESTION_STARTS = ["what", "who", "how", "when", "why", "which", "does", "is", "are", "under what"]
BAD_ANSWERS = [
    "forms an integral part of",
    "shall be deemed to be deleted and replaced",
    "under the section entitled",
    "with the prior approval of the promoter",
    r"this \w+ addendum",
    r"dated \d{1,2} [a-z]+ \d{4}",
]
FEE_WORDS = r"\b(fee|fees|charge|charges|expense|ongoing)\b|費用|收費|管理費|開支"

# domain, asset phrase, catalysts, drivers, regions, themes
TOPICS = [
    ("equity", "equity ETFs", ["earnings season update", "corporate guidance release", "equity outlook briefing"], ["earnings downgrade", "revenue slowdown", "valuation compression"],
     ["US large-cap", "China A-share", "Hong Kong", "Asia ex-Japan", "Europe"], ["broad equity benchmark", "quality factor", "high-dividend", "growth factor", "value factor"]),
    ("rates", "duration-sensitive bond exposures", ["FOMC meeting", "central bank policy statement", "inflation print release"], ["yield curve steepening", "rate hike expectations", "term premium shock"],
     ["US Treasury", "Euro area sovereign", "China government bond", "Asia USD bond"], ["long duration", "investment grade", "policy-rate sensitivity", "curve steepener"]),
    ("commodity", "commodity-linked holdings", ["OPEC supply announcement", "inventory report update", "commodity market briefing"], ["energy spike", "inventory drawdown", "raw material shortage"],
     ["Global", "US", "China", "Middle East"], ["energy complex", "precious metals", "industrial metals", "broad commodities"]),
    ("crypto", "crypto and digital-asset proxies", ["crypto regulation hearing", "exchange policy update", "risk sentiment shift"], ["bitcoin volatility", "risk-off flows", "regulatory uncertainty"],
     ["US", "Hong Kong", "Global"], ["spot bitcoin", "digital payments theme", "crypto miners", "exchange/platform beta"]),
    ("fx", "currency-sensitive allocations", ["currency policy signal", "FX reserve update", "cross-border flow data"], ["usd strength", "rmb weakness", "hedging cost increase"],
     ["USD", "CNH", "JPY", "EUR", "EM FX"], ["currency-hedged share class", "unhedged exposures", "carry-sensitive basket", "trade-weighted FX"]),
    ("credit", "corporate credit exposures", ["credit market update", "funding conditions release", "default cycle signal"], ["spread widening", "refinancing pressure", "default risk repricing"],
     ["US", "Europe", "China offshore", "Asia"], ["investment grade", "high yield", "short-duration credit", "financial subordinated debt"]),
    ("china", "mainland and china policy trades", ["China policy meeting", "mainland macro briefing", "regulatory circular"], ["policy easing", "property stress", "regulatory recalibration"],
     ["Mainland China", "Hong Kong-listed China", "Greater China"], ["internet platform", "SOE reform", "consumption recovery", "property-linked assets"]),
    ("us_macro", "us macro-sensitive allocations", ["US labor report", "Fed communication", "US fiscal update"], ["fed pivot risk", "labor data miss", "fiscal uncertainty"],
     ["US"], ["cyclical equities", "small-cap beta", "duration assets", "domestic demand theme"]),
    ("tech", "technology and innovation themes", ["big tech guidance release", "AI investment update", "semiconductor cycle briefing"], ["ai cycle repricing", "semiconductor weakness", "software demand slowdown"],
     ["US", "Taiwan", "Korea", "China"], ["semiconductors", "cloud software", "AI infrastructure", "consumer electronics"]),
    ("money_market", "cash and money-market sleeves", ["short-rate policy update", "funding market signal", "liquidity operations notice"], ["short-rate repricing", "funding pressure", "liquidity preference"],
     ["USD", "HKD", "CNH"], ["ultra-short duration", "treasury bills", "repo-linked liquidity", "cash management"]),
]
PARAPHRASES = [
    "{catalyst} is signaling {driver} for {region} {theme} {asset}.",
    "{region} {theme} {asset} are reacting as {catalyst} points to {driver}.",
    "{catalyst} now suggests {driver}, putting pressure on {region} {theme} {asset}.",
    "{region} {theme} {asset} are being repriced because {catalyst} indicates {driver}.",
    "{driver} is being signaled by {catalyst}, affecting {region} {theme} {asset}.",
    "After {catalyst}, markets are pricing in {driver} for {region} {theme} {asset}.",
    "{catalyst} implies {driver}, so {region} {theme} {asset} are under review.",
    "Investors read {catalyst} as a sign of {driver} for {region} {theme} {asset}.",
    "{region} {theme} {asset} face renewed risk after {catalyst} signaled {driver}.",
    "{driver} expectations increased following {catalyst}, impacting {region} {theme} {asset}.",
    "{catalyst} has shifted expectations toward {driver} for {region} {theme} {asset}.",
    "With {catalyst} released, {region} {theme} {asset} are exposed to {driver}.",
    "{region} {theme} {asset} are sensitive to {driver}, and {catalyst} reinforces that view.",
    "{catalyst} reinforces {driver} concerns around {region} {theme} {asset}.",
    "{driver} risk is rising for {region} {theme} {asset} as shown by {catalyst}.",
    "The message from {catalyst} is {driver}, which affects {region} {theme} {asset}.",
    "{region} {theme} {asset} are being reassessed since {catalyst} indicates {driver}.",
    "Following {catalyst}, traders link {region} {theme} {asset} to {driver}.",
    "{catalyst} and {driver} together are driving repricing in {region} {theme} {asset}.",
    "{region} {theme} {asset} pricing now reflects {driver} signaled by {catalyst}.",
]

# English question beginning, Chinese question; the first beginning that fits counts, so their order matters.
CHINESE_QUESTIONS = [
    ("What is the stock code", "這隻ETF的股票代號是甚麼"),
    ("What is the trading lot size", "這隻ETF每手交易單位是多少"),
    ("Who is the fund manager", "這隻ETF的基金經理是誰"),
    ("What index does", "這隻ETF追蹤哪個指數"),
    ("What is the base currency", "這隻ETF的基礎貨幣是甚麼"),
    ("What are the ongoing charges", "這隻ETF的全年持續費用是多少"),
    ("What is the latest tracking difference", "這隻ETF最新追蹤偏離是多少"),
    ("What is the dividend policy", "這隻ETF的派息政策是甚麼"),
    ("What is the investment objective", "這隻ETF的投資目標是甚麼"),
    ("How does", "這隻ETF如何執行其追蹤策略"),
    ("What are the key risks", "這隻ETF有哪些主要風險"),
    ("What risk factors are highlighted", "這隻ETF的產品資料概要重點風險有哪些"),
    ("Which risks could cause losses", "哪些風險可能導致這隻ETF出現虧損"),
    ("What fees and charges", "這隻ETF涉及哪些費用與收費"),
    ("What are the key trading and ongoing costs", "這隻ETF的交易與持有成本有哪些"),
    ("Does", "這隻ETF是否使用衍生工具，以及有甚麼限制"),
    ("How are futures/options/warrants addressed", "這隻ETF在文件中如何規範期貨、期權及認股權證"),
    ("What are the termination conditions", "這隻ETF在甚麼情況下可能終止"),
    ("Under what scenarios may", "這隻ETF在甚麼情況下可能被終止"),
    ("How does low NAV affect termination risk", "資產淨值偏低如何影響這隻ETF的終止風險"),
    ("How does dividend distribution work", "這隻ETF如何派發股息"),
    ("When are dividends generally paid", "這隻ETF一般在何時派息"),
    ("Are dividend payouts guaranteed", "這隻ETF派息是否有保證"),
    ("How do HKD and RMB counters work", "這隻ETF的港幣／人民幣櫃台如何運作"),
    ("What dual-counter risks", "這隻ETF的雙櫃台交易有甚麼風險"),
    ("What currency-related trading considerations", "這隻ETF在貨幣及交易櫃台方面有甚麼注意事項"),
    ("Is", "這隻ETF是否屬於被動管理"),
    ("What causes tracking error", "這隻ETF的追蹤誤差主要由甚麼造成"),
    ("What equity market risks affect", "這隻ETF面對哪些股票市場風險"),
]

# Facts of a key-facts sheet and what ends them.
KEY_FACTS = {
    "stock_code": r"Stock code:\s*([^\.]+?)(?:\s{2,}|Trading lot size:|Fund manager:|$)",
    "trading_lot_size": r"Trading lot size:\s*([^\.]+?)(?:\s{2,}|Fund manager:|Underlying index:|$)",
    "fund_manager": r"Fund manager:\s*([^\.]+?)(?:\s{2,}|Trustee and Custodian:|Underlying index:|$)",
    "underlying_index": r"Underlying index:\s*([^\.]+?)(?:\s{2,}|Trading currency:|Base currency:|$)",
    "base_currency": r"Base currency:\s*([^\.]+?)(?:\s{2,}|Ongoing charges|Financial year end|$)",
    "ongoing_charges": r"Ongoing charges over a year[#:\s]*([^\.]+?)(?:\s{2,}|Tracking difference|$)",
    "tracking_difference": r"Tracking difference[^:]*:\s*([^\.]+?)(?:\s{2,}|Financial year end|$)",
    "dividend_policy": r"Dividend policy[#:\s]*([^\.]+?)(?:\s{2,}|website|$)",
}

# Phrases of which one must stand in a reply for it to be corrected, in this order.
INVALID_CLAIMS = [
    "does not correspond to any known etf",
    "does not correspond to a known etf",
    "does not correspond to an existing etf",
    "is not a known etf",
    "not an existing etf",
    "isn't an etf",
    "is not in our database",
    "isn't in our database",
    "there isn't an etf with the ticker",
    "there is no etf with the ticker",
    "not found in our database",
    "couldn't find any information about the etf with the ticker",
    "could not find any information about the etf with the ticker",
    "might be incorrect",
    "not listed in the hong kong market",
    "confirm if",
    "correct ticker",
    "check the ticker again",
    "provide more details",
    "would you like more",
    "並不是一個現有的etf",
    "不是一個現有的etf",
    "未能找到對應的etf",
]
# The sentences that then go, in this order.
CLAIM_SENTENCES = [
    r"[^.\n]*there isn['’]t an etf with the ticker[^.\n]*[.\n]?",
    r"[^.\n]*there is no etf with the ticker[^.\n]*[.\n]?",
    r"[^.\n]*does not correspond to any known etf[^.\n]*[.\n]?",
    r"[^.\n]*does not correspond to an existing etf[^.\n]*[.\n]?",
    r"[^.\n]*isn['’]t in our database[^.\n]*[.\n]?",
    r"[^.\n]*is not in our database[^.\n]*[.\n]?",
    r"[^.\n]*couldn['’]t find any information about the etf with the ticker[^.\n]*[.\n]?",
    r"[^.\n]*could not find any information about the etf with the ticker[^.\n]*[.\n]?",
    r"[^.\n]*might be incorrect[^.\n]*[.\n]?",
    r"[^.\n]*not listed in the hong kong market[^.\n]*[.\n]?",
    r"[^.\n]*confirm if[^.\n]*correct ticker[^.\n]*[.\n]?",
    r"[^.\n]*check the ticker again[^.\n]*[.\n]?",
    r"[^.\n]*provide more details[^.\n]*[.\n]?",
    r"(?is)\bwould you like more.*$",
    r"[^。\n]*不是一個現有的etf[^。\n]*[。\n]?",
    r"[^。\n]*並不是一個現有的etf[^。\n]*[。\n]?",
    r"[^。\n]*未能找到對應的etf[^。\n]*[。\n]?",
]
# A line with the word and one of these goes at last.
CLAIM_LINE = "ticker"
CLAIM_LINE_WORDS = ["does not correspond", "not listed", "incorrect", "not in our database", "isn't an etf"]
# Sentences that deny data which is there, and cut-off tails, in this order.
INSUFFICIENT = [
    r"[^。\n]*目前本地資料不足以確認細節[^。\n]*[。\n]?",
    r"[^.\n]*local data is currently insufficient[^.\n]*[.\n]?",
    r"[^.\n]*insufficient local data[^.\n]*[.\n]?",
]
CUT_TAILS = [r"(?is)(\(|（)\s*key\s*$", r"(?is)\bwould you like more.*$"]

# Words by which a recorded question is of a kind, and by which an answer is about lot sizes.
LOOKUP_WORDS = {
    "risk": ["risk", "risks", "volatility", "風險", "波動"],
    "fee": ["fee", "charge", "expense", "費用", "收費", "管理費"],
    "dividend": ["dividend", "distribution", "yield", "派息", "股息", "分派"],
    "tracking": ["track", "index", "benchmark", "objective", "追蹤", "指數", "目標"],
}
LOT_WORDS = ["lot size", "trading lot size", "每手"]

# Patterns of the question topics, searched in any case.
TOPIC_PATTERNS = {
    "objective_strategy": r"\bobjective\b|\binvestment objective\b|\bstrategy\b|\brebalance\b",
    "key_risks": r"\bkey risks\b|\binvestment risk\b|\bindex risk\b|\btracking error\b|\bconcentration\b|\bvolatil",
    "fees_charges": r"\bfees\b|\bcharges\b|\bmanagement fee\b|\btrustee fee\b|\bstamp duty\b|\btrading fee\b",
    "derivatives": r"\bderivative\b|\bfutures\b|\boptions\b|\bwarrants\b|\bnet derivative exposure\b",
    "termination": r"\btermination\b|\bsuccessor index\b|\brolling three month\b|\bhk\\$3 billion\b",
    "dividend": r"\bdividend\b|\bsemi-annually\b|\bdistribution\b",
    "currency_counter": r"\bhkd counter\b|\brmb counter\b|\bdual counter\b|\btrading currency\b",
}

# Themes of an instrument's metadata; a query's themes are THEMES.
BUNDLE_THEMES = {
    "oil": ["oil", "crude", "wti", "brent", "石油", "原油", "能源"],
    "gold": ["gold", "bullion", "黃金"],
    "china_tech": ["china", "chinese", "tech", "科技", "科網", "internet"],
    "dividend": ["dividend", "yield", "income", "派息", "股息"],
    "bond": ["bond", "fixed income", "treasury", "債"],
    "money_market": ["money market", "cash", "貨幣市場"],
}

# Sentences that give no question, Chinese instructions that are none, and words that mark a Chinese one.
NOISY_SENTENCES = [
    r"all rights reserved",
    r"take no responsibility",
    r"no representation as to",
    r"copyright",
    r"http://",
    r"https://",
    r"\b\d{6,}\b",
    r"forms an integral part of",
    r"shall be deemed to be deleted and replaced",
    r"under the section entitled",
    r"with the prior approval of the promoter",
]
CHINESE_INSTRUCTIONS = ["請根據基金文件說明", "請總結", "請介紹"]
CHINESE_ASKING = ["是否", "甚麼", "什麼", "如何", "哪些", "哪個", "何時", "多少", "風險"]

# Question and answer of each key fact; {} is the ticker or the value.
FACT_QUESTIONS = {
    "stock_code": ("What is the stock code of ETF {}?", "The stock code is {}."),
    "trading_lot_size": ("What is the trading lot size for ETF {}?", "The trading lot size is {}."),
    "fund_manager": ("Who is the fund manager of ETF {}?", "The fund manager is {}."),
    "underlying_index": ("What index does ETF {} track?", "The ETF tracks {}."),
    "base_currency": ("What is the base currency of ETF {}?", "The base currency is {}."),
    "ongoing_charges": ("What are the ongoing charges of ETF {}?", "The ongoing charges are {}."),
    "tracking_difference": ("What is the latest tracking difference for ETF {}?", "The latest tracking difference is {}."),
    "dividend_policy": ("What is the dividend policy of ETF {}?", "The dividend policy is {}."),
}

# Questions of each topic.
TOPIC_QUESTIONS = {
    "objective_strategy": [
        "What is the investment objective of ETF {}?",
        "How does ETF {} implement its index-tracking strategy?",
        "How closely does ETF {} aim to replicate its benchmark?",
    ],
    "key_risks": [
        "What are the key risks investors should know for ETF {}?",
        "What risk factors are highlighted in the product key facts for ETF {}?",
        "Which risks could cause losses for ETF {} investors?",
    ],
    "fees_charges": [
        "What fees and charges apply to ETF {}?",
        "What are the key trading and ongoing costs for ETF {}?",
        "How do management and trustee fees work for ETF {}?",
    ],
    "derivatives": [
        "Does ETF {} use derivatives, and what are the limits?",
        "What is the derivative exposure framework for ETF {}?",
        "How are futures/options/warrants addressed in ETF {} documentation?",
    ],
    "termination": [
        "What are the termination conditions for ETF {}?",
        "Under what scenarios may ETF {} be terminated?",
        "How does low NAV affect termination risk for ETF {}?",
    ],
    "dividend": [
        "How does dividend distribution work for ETF {}?",
        "When are dividends generally paid for ETF {}?",
        "Are dividend payouts guaranteed for ETF {}?",
    ],
    "currency_counter": [
        "How do HKD and RMB counters work for ETF {}?",
        "What dual-counter risks should investors know for ETF {}?",
        "What currency-related trading considerations apply to ETF {}?",
    ],
}

# Pattern and question of answers that are one sentence.
SENTENCE_QUESTIONS = [
    (r"\bpassive exchange traded fund\b|\bpassive investment\b", "Is ETF {} actively managed or passive?"),
    (r"\bno guarantee\b|\brepayment of principal\b", "Is principal guaranteed when investing in ETF {}?"),
    (r"\btracking error\b", "What causes tracking error in ETF {}?"),
    (r"\bequity market risk\b|\bequity securities\b", "What equity market risks affect ETF {}?"),
]
CHINESE_ANSWER = "根據基金文件：{}"

# Words of an answer about fees, fragments of legal text, and the replies.
FEE_HINTS = ["ongoing charges", "expense ratio", "management fee", "費用", "收費", "管理費"]
LEGAL_FRAGMENTS = ["sub-section entitled", "forms an integral part", "addendum dated"]
FEE_REPLIES = {
    "en": (
        "Based on fund documents, ongoing charges are about {}% per year. Additional dealing/creation-redemption fees may also apply.",
        "Based on fund documents, this ETF has ongoing charges plus transaction and creation/redemption related fees; please refer to the latest KFS/prospectus for exact breakdown.",
    ),
    "zh": (
        "根據基金文件，這隻ETF的全年持續收費約為 {}%。另外，交易及申購/贖回可能涉及其他費用。",
        "根據基金文件，這隻ETF會有持續收費及交易相關費用；具體收費請以最新產品資料概要及基金章程為準。",
    ),
}

# Answers in plain words. Boilerplate that goes (any case), replacements in English answers, the fund's short
# name in Chinese ones, and answers that known phrases stand for, each in this order.
ANSWER_LEAD = r"^根據基金文件[:：]\s*"
BOILERPLATE = [
    r"under the section entitled [\"“][^\"”]+[\"”]",
    r"shall be deemed to be deleted and replaced with the following[:：]?",
    r"forms an integral part of[^\.]*",
    r"with the prior approval of the Promoter[^\.]*",
]
PLAIN_WORDS = [("Sub-Fund", "ETF"), ("The Sub -Fund", "The ETF"), ("TraHK", "the ETF"), ("Objective and Investment Strategy Objective", "Investment objective")]
PLAIN_WORDS_ZH = [("TraHK", "本ETF")]
PLAIN_END = "Quick facts"
KNOWN_FACTS = [
    (["closely correspond to the performance of the hang seng index"], "The fund aims to closely correspond to the performance of the Hang Seng Index."),
    (["tracks hang seng index"], "It tracks the Hang Seng Index."),
    (["track hang seng index"], "It tracks the Hang Seng Index."),
    (["investment objective", "hang seng index"], "Its investment objective is to closely track the Hang Seng Index."),
]

# The tags of a feature card with their labels, in this order, and the frames of replies.
FEATURE_TAGS = {
    "objective_strategy": ("Objective: ", "投資目標："),
    "fees_charges": ("Fee profile: ", "費用重點："),
    "dividend": ("Dividend: ", "派息資訊："),
    "key_risks": ("Risk highlights: ", "風險重點："),
    "currency_counter": ("Trading/currency counters: ", "交易櫃台/貨幣："),
}
FEATURE_REPLY = {
    "en": ("Key ETF features for `{}` (from fund documents):\n", "\n\nPortfolio construction advice: treat this ETF as a core or satellite position, then add ETFs from different regions/asset classes to reduce single-market concentration."),
    "zh": ("`{}` 的ETF特點如下（根據文件）：\n", "\n\n建議組合做法：可先把此ETF作為核心或衛星倉位，再搭配不同地區/資產類別ETF做分散，避免單一市場集中。"),
}
RISK_REPLY = {
    "en": ("Based on fund documents, the key risks include:\n", "\nWhat this means: if your portfolio is concentrated in one market/theme, consider adding other regions or asset classes to diversify volatility."),
    "zh": ("根據基金文件，主要風險包括：\n", "\n這代表甚麼：若你已集中港股或單一主題，宜搭配不同地區或資產類別ETF分散波動。"),
}
DISCOVERY_REPLY = {
    "en": ("Based on Model 2 (Synapse) semantic matching, these ETFs are most related to your information:\n", "- {i}. `{t}`: event `{e}`; headline summary `{h}`", "\nPractical next step: open 1-2 of these tickers, then compare holdings, 1Y trend, and fee profile."),
    "zh": ("根據Model 2（Synapse）語義匹配，以下ETF與你提供的資訊最相關：\n", "- {i}. `{t}`：事件 `{e}`；摘要 `{h}`", "\n建議：先點選其中1-2隻查看其持倉與1年走勢，再進一步比較風險與費用。"),
}
NO_DISCOVERY = {
    "en": "I could not find confident related ETFs from Model 2 (Synapse). Please provide more specific news/event keywords.",
    "zh": "未能從Model 2（Synapse）找到明確相關ETF。請提供更多新聞關鍵字、事件描述或市場主題。",
}
