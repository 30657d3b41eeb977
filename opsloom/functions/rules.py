"""Ordered pattern lists and the helper that applies them.

Patterns use no lookaround, so the same text runs in Spark and in the SQL used to check it.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsloom.functions.columns import let
from opsloom.functions.patterns import occurs

# --- fixed values: brand pattern -> display name, first match wins ------------------------------------------
BRANDS: list[tuple[str, str]] = [
    (r"AMZN|AMAZON", "Amazon"), (r"AMAZON\s?PRIME|PRIME VIDEO", "Amazon Prime"),
    (r"NETFLIX", "Netflix"), (r"SPOTIFY", "Spotify"), (r"HULU", "Hulu"), (r"DISNEY\s?(PLUS|\+)", "Disney+"),
    (r"YOUTUBE", "YouTube"), (r"APPLE\.COM|APPLE COM BILL|ITUNES", "Apple"), (r"UBER\s?EATS", "Uber Eats"),
    (r"UBER", "Uber"), (r"LYFT", "Lyft"), (r"DOORDASH", "DoorDash"), (r"GRUBHUB", "Grubhub"),
    (r"STARBUCKS", "Starbucks"), (r"DUNKIN", "Dunkin'"), (r"MCDONALD", "McDonald's"), (r"CHIPOTLE", "Chipotle"),
    (r"CHICK-?FIL-?A", "Chick-fil-A"), (r"WAL-?MART|WM SUPERCENTER", "Walmart"), (r"TARGET", "Target"),
    (r"COSTCO", "Costco"), (r"KROGER", "Kroger"), (r"WHOLE\s?FOODS|WHOLEFDS", "Whole Foods"),
    (r"TRADER JOE", "Trader Joe's"), (r"SAFEWAY", "Safeway"), (r"PUBLIX", "Publix"), (r"ALDI", "Aldi"),
    (r"WEGMANS", "Wegmans"), (r"SHELL", "Shell"), (r"EXXON", "Exxon"), (r"CHEVRON", "Chevron"),
    (r"HOME DEPOT", "The Home Depot"), (r"LOWE'?S", "Lowe's"), (r"\bCVS\b", "CVS"), (r"WALGREENS", "Walgreens"),
    (r"COMCAST|XFINITY", "Xfinity"), (r"VERIZON", "Verizon"), (r"AT&T|ATT\*", "AT&T"), (r"T-?MOBILE", "T-Mobile"),
    (r"GOOGLE\s?\*?\s?(STORAGE|ONE)", "Google One"), (r"MICROSOFT|MSFT", "Microsoft"), (r"ADOBE", "Adobe"),
    (r"VENMO", "Venmo"), (r"ZELLE", "Zelle"), (r"PAYPAL", "PayPal"), (r"BEST\s?BUY", "Best Buy"),
    (r"PLANET FITNESS", "Planet Fitness"), (r"OPENAI|CHATGPT", "OpenAI"), (r"ANTHROPIC|CLAUDE\.AI", "Anthropic"),
]
# "Amazon Prime" is not "Amazon": this text is blanked before the first brand pattern is tried.
PRIME = r"AMAZON\s?PRIME"

# --- fixed values: bank wording before the merchant ----------------------------------------------------------
PREFIXES = [
    r"PURCHASE AUTHORIZED ON \d{1,2}/\d{1,2}", r"DEBIT CARD PURCHASE", r"DEBIT PURCHASE", r"CHECKCARD \d{4}",
    r"CHECK CARD PURCHASE", r"POS (DEBIT|PURCHASE|PUR)?", r"VISA DDA PUR", r"CARD PURCHASE( WITH PIN)?",
    r"ACH (DEBIT|CREDIT|PMT|PAYMENT)", r"RECURRING (PAYMENT|DEBIT)( AUTHORIZED ON \d{1,2}/\d{1,2})?",
    r"PREAUTHORIZED (DEBIT|CREDIT)", r"ELECTRONIC (WITHDRAWAL|DEPOSIT)", r"WEB AUTHORIZED PMT",
    r"ONLINE (TRANSFER|PAYMENT)( TO| FROM)?", r"EXTERNAL (WITHDRAWAL|DEPOSIT)", r"BILL ?PAY(MENT)?",
    r"MOBILE PURCHASE", r"CONTACTLESS", r"INTL?", r"DBT", r"PUR",
]
PROCESSOR = r"^(SQ|TST|SP|PP|PAYPAL|GOOGLE|PY|IN|BT|DD|EB|ZTL|FS|WPY|CKO|PLI|LS)\s?\*\s*"
# --- fixed values: reference numbers, masks and ids (the fifth entry group spells out "8 or more characters
# with a digit among them", the "\B-" entry "a dash not after a word character") -----------------------------
NOISE = [
    r"\b(X{2,}|\*{2,})\d{2,}\b", r"#\s?\d+", r"\b\d{1,2}/\d{1,2}(/\d{2,4})?\b", r"\b\d{3,}\b",
    r"\b(" + "|".join(rf"[A-Z]{{{k}}}\d[A-Z0-9]{{{7 - k},}}" for k in range(7)) + r"|[A-Z]{7,}\d[A-Z0-9]*)\b",
    r"\*[A-Z0-9]{3,}", r"\bSTORE\b", r"\bCARD \d{4}\b", r"\bREF\s?\w+",
    r"\b\d{3}[-.]\d{3}[-.]\d{4}\b", r"\bX{2,}[-.]?X{2,}[-.]?\d{2,}\b", r"\B-\d{3,}\b", r"\bCO ID\b.*",
    r"\bPPD ID\b.*", r"\bWEB ID\b.*", r"\bID:.*",
]
STATES = ("AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH "
          "OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC").split()
CITY_WORDS = ("SAN|LOS|LAS|NEW|ST|SAINT|FORT|FT|EL|SANTA|SALT|PALM|BATON|LONG|PORT|NORTH|SOUTH|WEST|EAST|GRAND|CEDAR|"
              "COLORADO|KANSAS|OKLAHOMA|JERSEY|VIRGINIA|SIOUX|ANN|CORPUS|DES|LITTLE|MOUNT|MT")
WORDLIKE_STATES = {"CO", "IN", "OR", "ME", "OK", "HI", "DE", "LA", "MA", "PA", "AL", "ID"}
KEEP_UPPER = ["ATM", "IRS", "USA", "HOA", "LLC", "BP", "CVS", "ACH", "TV", "DMV", "AT&T"]
RAW_HINT = r"\d{3,}|X{3,}|\*|#|\b(POS|ACH|DEBIT|PURCHASE)\b"

# --- fixed values: built-in categories: name, kind, essential -----------------------------------------------
BUILTIN_CATEGORIES: list[tuple[str, str, bool]] = [
    ("Salary", "income", False), ("Interest & Dividends", "income", False), ("Refunds", "income", False),
    ("Other Income", "income", False), ("Transfer", "transfer", False), ("Credit Card Payment", "transfer", False),
    ("Housing", "expense", True), ("Utilities", "expense", True), ("Phone & Internet", "expense", True),
    ("Groceries", "expense", True), ("Dining & Coffee", "expense", False), ("Transportation", "expense", True),
    ("Fuel", "expense", True), ("Insurance", "expense", True), ("Healthcare", "expense", True),
    ("Shopping", "expense", False), ("Entertainment", "expense", False), ("Subscriptions", "expense", False),
    ("Travel", "expense", False), ("Personal Care", "expense", False), ("Education", "expense", False),
    ("Childcare", "expense", True), ("Pets", "expense", False), ("Gifts & Donations", "expense", False),
    ("Fees & Interest", "expense", False), ("Taxes", "expense", True), ("Loan Payment", "expense", True),
    ("Cash & ATM", "expense", False), ("Home Improvement", "expense", False), ("Uncategorized", "expense", False),
]
# --- fixed values: pattern on description or merchant, category, sign (+1 inflow, -1 outflow, 0 any) --------
BUILTIN_RULES: list[tuple[str, str, int]] = [
    (r"PAYROLL|DIRECT DEP|DIR DEP|SALARY|PAYCHECK|\bPAYRL\b", "Salary", 1),
    (r"INTEREST (PAID|CREDIT|EARNED)|DIVIDEND|\bINT PD\b", "Interest & Dividends", 1),
    (r"INTEREST CHARGE|FINANCE CHARGE|LATE FEE|OVERDRAFT|SERVICE (FEE|CHARGE)|ANNUAL FEE|FOREIGN TRANSACTION FEE|ATM FEE|MONTHLY MAINTENANCE", "Fees & Interest", -1),
    (r"PAYMENT THANK YOU|AUTOPAY PAYMENT|AUTOMATIC PAYMENT|CARD PAYMENT|CREDIT CARD|E-?PAYMENT|(CHASE|AMEX|AMERICAN EXPRESS|CITI|DISCOVER|CAPITAL ONE|BARCLAYCARD|SYNCHRONY).{0,20}(PAYMENT|PMT|AUTOPAY)", "Credit Card Payment", 0),
    (r"REFUND|RETURN CREDIT|REVERSAL", "Refunds", 1),
    (r"\bTRANSFER\b|\bXFER\b|ZELLE|VENMO|CASH APP|SAVINGS DEPOSIT|TO SAVINGS|FROM SAVINGS|FROM CHECKING|TO CHECKING", "Transfer", 0),
    (r"\bRENT\b|MORTGAGE|\bHOA\b|PROPERTY M(GMT|ANAGEMENT)|APARTMENTS?\b", "Housing", -1),
    (r"ELECTRIC|POWER CO|ENERGY|\bGAS CO|NATURAL GAS|WATER (DEPT|UTIL|AUTH)|SEWER|UTILIT|PG&E|CON ED|DUKE ENERGY|\bFPL\b|DOMINION|NATIONAL GRID", "Utilities", -1),
    (r"VERIZON|AT&T|ATT\*|T-?MOBILE|COMCAST|XFINITY|SPECTRUM|\bCOX\b|INTERNET|WIRELESS|FIBER|MINT MOBILE|GOOGLE FI|FRONTIER COMM", "Phone & Internet", -1),
    (r"NETFLIX|SPOTIFY|HULU|DISNEY ?(PLUS|\+)|\bHBO\b|MAX\.COM|YOUTUBE ?(PREMIUM|TV)|APPLE\.COM/BILL|ICLOUD|GOOGLE ?\*? ?(STORAGE|ONE)|PRIME VIDEO|AMAZON PRIME|PATREON|ADOBE|MICROSOFT ?365|DROPBOX|PARAMOUNT|PEACOCK|AUDIBLE|CHATGPT|OPENAI|ANTHROPIC|CLAUDE\.AI|SIRIUS|NYTIMES|WSJ", "Subscriptions", -1),
    (r"GROCER|SUPERMARKET|KROGER|SAFEWAY|WHOLE ?FOODS|WHOLEFDS|TRADER JOE|\bALDI\b|PUBLIX|WEGMANS|\bH-?E-?B\b|COSTCO|SAM'?S CLUB|FOOD LION|GIANT EAGLE|SPROUTS|HARRIS TEETER|MEIJER|STOP & SHOP|FRESH MARKET|INSTACART", "Groceries", -1),
    (r"UBER ?EATS|DOORDASH|GRUBHUB|POSTMATES|RESTAURANT|\bCAFE\b|COFFEE|STARBUCKS|DUNKIN|MCDONALD|CHIPOTLE|PIZZA|BURGER|\bGRILL\b|TACO|SUSHI|\bBAR\b|BISTRO|DINER|KITCHEN|SUBWAY|WENDY|CHICK-?FIL-?A|PANERA|\bTST\*|BAKERY|BREWING|\bPUB\b", "Dining & Coffee", -1),
    (r"\bSHELL\b|EXXON|MOBIL|CHEVRON|\bBP\b|SUNOCO|CITGO|MARATHON PETRO|WAWA|SHEETZ|\bGAS STATION|\bFUEL|SPEEDWAY|CIRCLE K|QUIKTRIP|VALERO", "Fuel", -1),
    (r"\bUBER\b|\bLYFT\b|PARKING|\bTOLL|E-?ZPASS|SUNPASS|TRANSIT|\bMETRO\b|\bMTA\b|AMTRAK|\bDMV\b|AUTO REPAIR|JIFFY LUBE|CAR WASH|TIRE", "Transportation", -1),
    (r"INSURANCE|GEICO|STATE FARM|PROGRESSIVE|ALLSTATE|LIBERTY MUTUAL|\bINSUR|NATIONWIDE|USAA INS", "Insurance", -1),
    (r"PHARMACY|\bCVS\b|WALGREENS|RITE AID|MEDICAL|DENTAL|DENTIST|DOCTOR|HOSPITAL|CLINIC|HEALTH|OPTOM|URGENT CARE|LABCORP|QUEST DIAG", "Healthcare", -1),
    (r"HOME DEPOT|LOWE'?S|MENARDS|ACE HARDWARE|HARBOR FREIGHT", "Home Improvement", -1),
    (r"CINEMA|THEATRE|THEATER|\bAMC\b|STEAM ?GAMES|STEAMPOWERED|PLAYSTATION|XBOX|NINTENDO|TICKETMASTER|STUBHUB|CONCERT|BOWLING", "Entertainment", -1),
    (r"AIRLINE|DELTA AIR|UNITED AIR|AMERICAN AIR|SOUTHWEST|JETBLUE|SPIRIT AIR|HOTEL|MARRIOTT|HILTON|HYATT|AIRBNB|EXPEDIA|BOOKING\.COM|VRBO", "Travel", -1),
    (r"SALON|BARBER|\bSPA\b|\bNAIL|ULTA|SEPHORA|\bGYM\b|FITNESS", "Personal Care", -1),
    (r"TUITION|SCHOOL|UNIVERSITY|COLLEGE|UDEMY|COURSERA", "Education", -1),
    (r"DAYCARE|CHILDCARE|PRESCHOOL|KINDERCARE", "Childcare", -1),
    (r"PETCO|PETSMART|CHEWY|\bVET\b|VETERINAR", "Pets", -1),
    (r"DONATION|CHARITY|GOFUNDME|CHURCH|RED CROSS|UNITED WAY", "Gifts & Donations", -1),
    (r"\bIRS\b|US TREASURY TAX|DEPT OF REVENUE|TAX PAYMENT|FRANCHISE TAX", "Taxes", -1),
    (r"\bLOAN\b|STUDENT LN|NAVIENT|NELNET|SALLIE MAE|MOHELA|AUTO FINANCE|TOYOTA FIN|HONDA FIN|ALLY AUTO", "Loan Payment", -1),
    (r"ATM WITHDRAWAL|CASH WITHDRAWAL|\bATM\b", "Cash & ATM", -1),
    (r"AMAZON|AMZN|WALMART|WAL-MART|TARGET|BEST ?BUY|EBAY|ETSY|IKEA|MACY|KOHL|NORDSTROM|TJ ?MAXX|MARSHALLS|\bROSS\b|SHEIN|TEMU", "Shopping", -1),
]
# --- fixed values: label of another ledger app -> built-in category ("-" means explicitly none) -------------
SOURCE_GROUPS: list[tuple[str, str]] = [
    (r"allowance|pocket money", "-"),
    (r"credit card payment|card payment", "Credit Card Payment"),
    (r"saving|investment|certificate|\bcds?\b|retirement|401\(?k|\bira\b|brokerage|emergency fund", "Transfer"),
    (r"^transfer|transfer$|\btransfers?\b", "Transfer"),
    (r"paycheck|salary|wages|payroll", "Salary"),
    (r"interest income|dividend|interest earned", "Interest & Dividends"),
    (r"refund|reimburse|rebate|cash ?back", "Refunds"),
    (r"home improvement|hardware|home repair|maintenance", "Home Improvement"),
    (r"rent|mortgage|\bhoa\b|housing", "Housing"),
    (r"utilit|electric|water|sewer|trash|natural gas|gas & electric", "Utilities"),
    (r"phone|mobile|internet|cable|wireless", "Phone & Internet"),
    (r"grocer", "Groceries"),
    (r"restaurant|dining|fast food|coffee|food & drink|alcohol|bars?\b|takeout|delivery", "Dining & Coffee"),
    (r"insurance", "Insurance"),
    (r"\bgas\b|fuel|gasoline", "Fuel"),
    (r"auto|transport|parking|toll|ride ?share|taxi|public transit|car ", "Transportation"),
    (r"medical|doctor|dentist|dental|pharmacy|health|vision|hospital", "Healthcare"),
    (r"subscription|streaming|software", "Subscriptions"),
    (r"entertainment|movies?|music|games?|hobbies|sports|events", "Entertainment"),
    (r"travel|vacation|hotel|lodging|air ?fare|flights?", "Travel"),
    (r"personal care|hair|spa|gym|fitness|beauty", "Personal Care"),
    (r"education|tuition|books|school|student", "Education"),
    (r"child ?care|daycare|kids|baby|babysit", "Childcare"),
    (r"\bpets?\b|veterinar|\bvet\b", "Pets"),
    (r"gift|charit|donation|church|tithe", "Gifts & Donations"),
    (r"bank fee|service fee|late fee|finance charge|interest (charge|paid|expense)|\bfees?\b", "Fees & Interest"),
    (r"\btax", "Taxes"),
    (r"loan|student debt", "Loan Payment"),
    (r"\bcash\b|\batm\b", "Cash & ATM"),
    (r"shopping|clothing|electronics|merchandise|household|home goods|amazon", "Shopping"),
    (r"income|deposit|bonus", "Other Income"),
]
OWN_TRANSFER = r"^(online |mobile |internal |automatic )?(transfer|xfer)\s+(to|from)\b|\b(to|from) (savings|checking|certificate|cd|share|money market)\b"
INCOME_HINT = r"income|paycheck|salary|wages|deposit|bonus|dividend|refund|reimburse"
TRANSFER_HINT = r"transfer|credit card payment|^savings$|:savings$|investment|certificate|\bcds?\b|retirement|401\(?k|\bira\b|brokerage"
SUBSCRIPTION_HINT = r"subscri|stream|software|online service|membership|apps?\b|music|magazine|news|cloud|storage|backup|gaming|games|video|entertainment|dues|gym|fitness"
ESSENTIAL_GROUPS = ["Housing", "Utilities", "Phone & Internet", "Groceries", "Transportation", "Fuel", "Insurance",
                    "Healthcare", "Childcare", "Taxes", "Loan Payment"]
BILL_GROUPS = ["Housing", "Utilities", "Phone & Internet", "Insurance", "Loan Payment", "Childcare", "Taxes", "Education"]
# --- fixed values: account label -> account type -------------------------------------------------------------
ACCOUNT_TYPES: list[tuple[str, str]] = [
    (r"credit|card|visa|mastercard|amex|american express|discover|freedom|sapphire|venture|quicksilver|rewards", "credit_card"),
    (r"saving|money market|\bmm\b|\bhysa\b|cd\b", "savings"),
    (r"loan|mortgage|auto loan|student|heloc|line of credit", "loan"),
    (r"cash|wallet", "cash"),
]


def first_match(text: Column, rules: Sequence[tuple[str, str]], ignore_case: bool = False, default: Column | None = None) -> Column:
    """Value of the first rule whose pattern occurs in the text: one short-circuiting projection, no join."""
    def chain(t: Column) -> Column:
        start = F.when(occurs(t, rules[0][0], ignore_case), F.lit(rules[0][1]))
        full = reduce(lambda acc, r: acc.when(occurs(t, r[0], ignore_case), F.lit(r[1])), rules[1:], start)
        return full if default is None else full.otherwise(default)
    return let(F.lower(text), chain) if ignore_case else chain(text)


def kind_of(category: Column) -> Column:
    """Kind of a built-in category; null for any other name."""
    def named(kind):
        return [n for n, k, _ in BUILTIN_CATEGORIES if k == kind]
    return let(category, lambda c: F.when(c.isin(named("expense")), "expense").when(c.isin(named("income")), "income")
               .when(c.isin(named("transfer")), "transfer"))
