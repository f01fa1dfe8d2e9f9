"""Fixed rule values for admission and classification.

Every value in this module is fixed: results must match these lists entry by entry and, where
the first match wins, in this order.
"""

# URL parts refused by the admission check, matched as substrings.
BLOCKED_URL_PARTS = """
chat.openai.com chatgpt.com platform.openai.com claude.ai console.anthropic.com
console.groq.com groq.com gemini.google.com aistudio.google.com bard.google.com
copilot.microsoft.com copilot.github.com poe.com perplexity.ai you.com
labs.perplexity.ai chat.mistral.ai coral.cohere.com lmsys.org together.ai
accounts.google.com login.microsoftonline.com appleid.apple.com id.apple.com
login.yahoo.com auth0.com okta.com onelogin.com
sso. login. signin. oauth. auth.
chase.com bankofamerica.com wellsfargo.com citi.com citibank.com usbank.com
capitalone.com ally.com discover.com tdbank.com pnc.com fidelity.com schwab.com
vanguard.com etrade.com robinhood.com sofi.com marcus.com americanexpress.com
hsbc.com barclays.co.uk natwest.com lloydsbank.com halifax.co.uk nationwide.co.uk
tsb.co.uk monzo.com revolut.com starlingbank.com
db.com ing.com bnpparibas.com credit-suisse.com ubs.com
hdfcbank.com icicibank.com sbi.co.in onlinesbi.sbi kotak.com axisbank.com
yesbank.in idfcfirstbank.com
onlinebanking. netbanking. ibanking. ebanking. mobilebanking. secure.
paypal.com venmo.com stripe.com square.com wise.com razorpay.com
paytm.com phonepe.com gpay.com crypto.com coinbase.com binance.com kraken.com
mail.google.com outlook.live.com outlook.office.com outlook.office365.com
mail.yahoo.com protonmail.com mail.proton.me
web.whatsapp.com web.telegram.org discord.com slack.com teams.microsoft.com
messenger.com messages.google.com
mychart.com mychartsso.com healthvault.com
vault.bitwarden.com my.1password.com lastpass.com dashlane.com keeper.io
irs.gov ssa.gov turbotax.intuit.com
chrome:// about: edge:// brave:// chrome-extension:// moz-extension://
facebook.com instagram.com tiktok.com twitter.com/home x.com/home
snapchat.com pinterest.com
netflix.com disneyplus.com primevideo.com hulu.com hbomax.com peacocktv.com
spotify.com music.youtube.com music.apple.com
checkout. cart.
""".split()

# Path patterns refused by the admission check, on the lower-cased path.
BLOCKED_PATHS = (
    r"/log-?in(/|$)",
    r"/sign-?(in|up|out)(/|$)",
    r"/(account|profile|settings|preferences|dashboard)(/|$)",
    r"/(cart|checkout|payment|billing|receipt)(/|$)",
    r"/(auth|oauth|callback|sso|token)(/|$)",
    r"/(unsubscribe|opt-?out|confirm)(/|$)",
    r"/(password|reset|forgot|2fa|mfa|verify)(/|$)",
    r"/\d+[x×]\d+",
)

# Hosts refused at capture time, exact or as a parent domain.
CAPTURE_BLOCKED_HOSTS = """
chat.openai.com chatgpt.com platform.openai.com claude.ai console.anthropic.com
console.groq.com groq.com gemini.google.com aistudio.google.com bard.google.com
copilot.microsoft.com copilot.github.com poe.com perplexity.ai you.com
huggingface.co/chat labs.perplexity.ai chat.mistral.ai coral.cohere.com
lmsys.org together.ai
chase.com secure.chase.com bankofamerica.com secure.bankofamerica.com
wellsfargo.com citi.com usbank.com capitalone.com ally.com
discover.com tdbank.com pnc.com fidelity.com schwab.com
vanguard.com etrade.com robinhood.com sofi.com marcus.com
americanexpress.com hsbc.com barclays.co.uk natwest.com
lloydsbank.com halifax.co.uk nationwide.co.uk tsb.co.uk
monzo.com revolut.com starlingbank.com db.com ing.com
bnpparibas.com credit-suisse.com ubs.com
hdfcbank.com icicibank.com sbi.co.in onlinesbi.sbi
kotak.com axisbank.com yesbank.in idfcfirstbank.com
paypal.com venmo.com stripe.com square.com wise.com
razorpay.com paytm.com phonepe.com gpay.com
crypto.com coinbase.com binance.com kraken.com
mail.google.com outlook.live.com outlook.office.com
outlook.office365.com mail.yahoo.com protonmail.com mail.proton.me
web.whatsapp.com web.telegram.org discord.com slack.com
teams.microsoft.com messenger.com messages.google.com
accounts.google.com login.microsoftonline.com appleid.apple.com
id.apple.com login.yahoo.com auth0.com okta.com onelogin.com
mychart.com mychartsso.com patient.portal healthvault.com
vault.bitwarden.com my.1password.com lastpass.com dashlane.com keeper.io
irs.gov ssa.gov turbotax.intuit.com
facebook.com instagram.com tiktok.com snapchat.com reddit.com
pinterest.com linkedin.com/feed
netflix.com disneyplus.com primevideo.com hulu.com
hbomax.com peacocktv.com spotify.com music.youtube.com music.apple.com
""".split()

# Host substrings refused at capture time.
CAPTURE_BLOCKED_HOST_PARTS = """
onlinebanking. netbanking. ibanking. ebanking. mobilebanking.
secure.bank login. signin. sso. oauth. auth. accounts.
checkout. pay. payment.
""".split()

# Path patterns refused at capture time, on the lower-cased path.
CAPTURE_BLOCKED_PATHS = (
    r"/log-?in(/|$)",
    r"/sign-?(in|up|out)(/|$)",
    r"/(account|profile|settings|preferences|dashboard)(/|$)",
    r"/(cart|checkout|payment|billing|receipt|order)(/|$)",
    r"/(auth|oauth|callback|sso|token|verify|confirm)(/|$)",
    r"/(password|reset|forgot|2fa|mfa)(/|$)",
)

# Known content hosts (substring, first match wins) and their content type.
CONTENT_HOSTS = (
    ("docs.python.org", "documentation"),
    ("developer.mozilla.org", "documentation"),
    ("docs.microsoft.com", "documentation"),
    ("learn.microsoft.com", "documentation"),
    ("docs.aws.amazon.com", "documentation"),
    ("cloud.google.com", "documentation"),
    ("pytorch.org", "documentation"),
    ("huggingface.co", "documentation"),
    ("en.wikipedia.org", "reference"),
    ("stackoverflow.com", "forum"),
    ("stackexchange.com", "forum"),
    ("github.com", "reference"),
    ("arxiv.org", "article"),
    ("medium.com", "article"),
    ("dev.to", "article"),
    ("hackernews.com", "news"),
    ("news.ycombinator.com", "news"),
    ("techcrunch.com", "news"),
    ("arstechnica.com", "news"),
    ("theverge.com", "news"),
    ("wired.com", "news"),
)

# Content path patterns on the lower-cased path (first match wins).
CONTENT_PATHS = (
    (r"/blog(s)?(/|$)", "blog"),
    (r"/article(s)?(/|$)", "article"),
    (r"/post(s)?(/|$)", "blog"),
    (r"/doc(s|umentation)?(/|$)", "documentation"),
    (r"/guide(s)?(/|$)", "documentation"),
    (r"/tutorial(s)?(/|$)", "documentation"),
    (r"/wiki(/|$)", "reference"),
    (r"/reference(/|$)", "reference"),
    (r"/learn(ing)?(/|$)", "documentation"),
    (r"/news(/|$)", "news"),
    (r"/paper(s)?(/|$)", "article"),
    (r"/research(/|$)", "article"),
    (r"/(question|answer|thread|discussion)(/|$)", "forum"),
)

# Fixed value: two or more hyphenated words in a path segment.
SLUG_PATH = r"/\w++(?:-\w++)++"

# Score parts in hundredths.
HOST_POINTS = 40
PATH_POINTS = 30
SLUG_POINTS = 15
DEPTH_POINTS = 5
WORD_BANDS = ((100, 10), (200, 15), (500, 10), (1000, 5))
RATIO_BANDS = ((0.3, 10), (0.5, 5))
TITLE_POINTS = 5
MIN_QUALITY = 30

# Personal-data patterns.
CARD_PATTERN = r"\b\d[\d -]{11,24}\d\b"
SSN_PATTERN = r"\b\d{3}-\d{2}-\d{4}\b"
IBAN_PATTERN = r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"
EMAIL_PATTERN = r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"

# Phrases that dominate sign-in pages.
AUTH_PHRASES = (
    "sign in to continue", "log in to your account", "sign in to your account",
    "forgot password", "forgot your password", "remember me",
    "enter the code", "one-time password", "verification code",
    "verify your identity", "session expired", "session has expired",
    "access denied", "two-factor authentication", "create an account",
)

# Autocomplete tokens reserved for credentials and payment data.
SENSITIVE_AUTOCOMPLETE = (
    "current-password", "new-password", "one-time-code",
    "cc-number", "cc-csc", "cc-exp", "cc-exp-month", "cc-exp-year", "cc-name",
)

# Page-length limits in words.
SHORT_PAGE_WORDS = 400
AUTH_PAGE_WORDS = 150
MIN_PAGE_WORDS = 50

# Prototype sentences of the junk gate.
JUNK_PROTOTYPES = (
    ("login", "A login page asking for a username, email address, and password to sign in to an account."),
    ("signup", "A registration page asking the user to create an account with a password and personal details."),
    ("2fa", "A verification page asking the user to enter a one-time security code sent to their phone or email."),
    ("account", "An account settings dashboard showing profile, security, notification, and billing preferences."),
    ("checkout", "A shopping cart checkout page asking for shipping address and credit card payment details."),
    ("banking", "An online banking portal showing account balances, recent transactions, and transfer options."),
    ("error", "An error page saying access is denied, the page was not found, or the session has expired."),
    ("cookiewall", "A consent page asking the visitor to accept cookies and privacy terms before continuing."),
)
CONTENT_PROTOTYPES = (
    ("article", "An informative article or blog post explaining a topic in depth with paragraphs of prose."),
    ("docs", "Technical documentation describing how to install, configure, and use a software library."),
    ("news", "A news report describing a recent event with quotes, background, and analysis."),
    ("forum", "A question and answer discussion thread where people explain a problem and its solutions."),
)

# Entity label -> stored type; labels mapped to "skip" are dropped.
ENTITY_TYPES = {
    "PERSON": "person",
    "ORG": "organization",
    "GPE": "location",
    "LOC": "location",
    "FAC": "facility",
    "PRODUCT": "product",
    "WORK_OF_ART": "work",
    "EVENT": "event",
    "LAW": "law",
    "LANGUAGE": "language",
    "NORP": "group",
    "MONEY": "skip",
    "QUANTITY": "skip",
    "ORDINAL": "skip",
    "CARDINAL": "skip",
    "PERCENT": "skip",
    "DATE": "skip",
    "TIME": "skip",
}
MIN_ENTITY_LENGTH = 2
MAX_ENTITY_LENGTH = 100

# Elements dropped by the subtractive text extraction.
BOILERPLATE_TAGS = (
    "script", "style", "nav", "footer", "header", "aside", "iframe", "noscript",
    "svg", "canvas", "video", "audio", "form",
)
BOILERPLATE_ROLES = ("navigation", "banner", "complementary")
BOILERPLATE_CLASSES = (
    "sidebar", "nav", "menu", "footer", "header", "ad",
    "advertisement", "social-share", "cookie-banner", "popup", "modal",
)
MIN_ARTICLE_CHARS = 200
