"""The ordered word lists of categories, merchants and masters, whose first word that a text holds decides.

Each entry gives its words in order, apart by commas. Longer lists, such as one of all banks' category names, are given as tables.
"""

from __future__ import annotations

# category, confidence: words in a staged row's text
CATEGORY_KEYWORDS = [
    ("Groceries", "high", "whole foods,safeway,trader joe,kroger,publix,aldi,wegmans,sprouts,foodland,times supermarket"),
    ("Shopping", "high", "walmart,target"),
    ("Food & Dining", "high", "mcdonald,starbucks,subway,chipotle,doordash,grubhub,uber eats,taco bell,burger king,pizza hut,domino,panera,dunkin,chick-fil-a,wendy,panda express,postmates"),
    ("Food & Dining", "medium", "instacart"),
    ("Transport", "high", "shell ,chevron,exxon,mobil,texaco,valero,speedway,circle k,wawa,sheetz"),
    ("Transport", "medium", "uber"),
    ("Transport", "high", "lyft,e-zpass,ezpass,autozone,jiffy lube"),
    ("Entertainment", "high", "netflix,hulu,disney,hbo,paramount,peacock"),
    ("Subscriptions", "high", "spotify,apple.com/bill,google play"),
    ("Subscriptions", "medium", "microsoft"),
    ("Subscriptions", "high", "adobe,dropbox,notion,openai,chatgpt,anthropic,zoom,github"),
    ("Shopping", "high", "amazon,costco,home depot,lowes,best buy,ikea,wayfair,ebay,etsy,kohls,tj maxx,marshalls"),
    ("Health", "high", "cvs,walgreens,rite aid,longs drug,planet fitness,la fitness,ymca"),
    ("Utilities", "high", "at&t,verizon,t-mobile,xfinity,comcast,spectrum"),
    ("Travel", "high", "airbnb,marriott,hilton,delta air,united air,southwest air,expedia,booking.com"),
    ("Insurance", "high", "usaa,geico,state farm,allstate,progressive"),
    ("Income", "high", "direct dep,payroll,salary"),
    ("Income", "medium", "employer"),
    ("Transfer", "high", "zelle,venmo"),
    ("Transfer", "medium", "paypal"),
    ("Transfer", "high", "cash app,bank transfer,loan pymt,mortgage"),
    ("Fees & Charges", "high", "annual fee,late payment,overdraft,foreign transaction"),
]

# category: words in a bank's category name
BANK_KEYWORDS = [
    ("Groceries", "grocery,supermarket"), ("Food & Dining", "restaurant,dining"), ("Coffee", "coffee,espresso"), ("Food & Dining", "fast food,food drink,food and"),
    ("Transport", "gasoline,fuel,rideshare,parking,transit,automotive"), ("Entertainment", "entertainment,recreation,nightlife"), ("Subscriptions", "streaming,subscription,membership"),
    ("Utilities", "utilities,electric,internet,wireless"), ("Health", "pharmacy,healthcare,medical,fitness,wellness,dental"), ("Insurance", "insurance"), ("Housing", "mortgage,home"),
    ("Travel", "hotel,airline,travel,lodging"), ("Education", "education,tuition"), ("Personal Care", "personal care,beauty"), ("Gifts & Charity", "charity,donation"),
    ("Fees & Charges", "fee,charge"), ("Income", "payroll,salary,direct deposit,refund"), ("Transfer", "transfer"), ("Credit Card Payment", "credit card payment,card payment,payment thank you,autopay"),
    ("Transfer", "payment"), ("Shopping", "shopping,retail,clothing"), ("Pets", "pet"),
]

# master: words in a category's name
MASTERS = [
    ("COFFEE", "coffee,café,cafe,espresso,tea"), ("GROCERY", "groceries,grocery,supermarket"), ("FAST_FOOD", "fast food"), ("ALCOHOL", "alcohol,nightlife,brewery,winery,liquor"),
    ("FOOD", "food,dining,restaurant,meal,bar,drinks"), ("TRANSPORT", "transport,gas,fuel,uber,lyft,parking,transit,auto,vehicle,toll"),
    ("HOME", "housing,rent,mortgage,utilities,internet,phone,home improvement,furniture,decor,cleaning,security"),
    ("HEALTH", "health,gym,fitness,pharmacy,medical,dental,mental health,supplement,wellness,vision,doctor"),
    ("ENTERTAINMENT", "entertainment,movie,music,event,concert,sport,hobby,game,night out"), ("SHOPPING", "shopping,clothing,fashion,electronics,amazon,online,department"),
    ("TRAVEL", "travel,flight,hotel,airbnb,vacation,car rental,cruise"), ("DIGITAL", "subscription,software,saas,streaming,app,cloud,tech"),
    ("PERSONAL_CARE", "personal care,beauty,cosmetic,hair,salon,spa,massage,grooming"), ("EDUCATION", "education,tuition,course,book,learning,coaching,certification,conference"),
    ("BUSINESS", "business,coworking,advertising,contractor,freelance,office,professional"), ("SOCIAL", "gift,charity,donation,celebration,wedding,holiday"),
    ("FINANCIAL", "insurance,fee,charge,credit card,loan,interest,bank,investment,savings"), ("PETS", "pet"), ("TOBACCO", "tobacco,cigarette"), ("LIFESTYLE", "gambling,lottery"),
]

# expression, merchant, type
CANONICAL = [
    (r"\bamazon\b|\bamzn\b", "Amazon", "shopping"), (r"\bapple\.com\/bill\b|\bapple\s+cash\b|\bitunes\b", "Apple", "subscription"), (r"\bgoogle\s+play\b|\bgoogle\s+\*\b", "Google Play", "subscription"),
    (r"\bsafeway\b", "Safeway", "grocery"), (r"\bwhole\s+foods\b", "Whole Foods", "grocery"), (r"\btrader\s+joe", "Trader Joe's", "grocery"), (r"\bkroger\b", "Kroger", "grocery"), (r"\bpublix\b", "Publix", "grocery"),
    (r"\baldi\b", "Aldi", "grocery"), (r"\bwegmans\b", "Wegmans", "grocery"), (r"\bsprouts\b", "Sprouts", "grocery"), (r"\bfoodland\b", "Foodland", "grocery"), (r"\btimes\s+supermarket\b", "Times Supermarket", "grocery"),
    (r"\bwalmarts?\b", "Walmart", "shopping"), (r"\btarget\b", "Target", "shopping"),
    (r"\bshell\b", "Shell", "gas"), (r"\bchevron\b", "Chevron", "gas"), (r"\bexxon(mobil)?\b", "ExxonMobil", "gas"), (r"\bmobil\b", "Mobil", "gas"), (r"\btexaco\b", "Texaco", "gas"), (r"\bvalero\b", "Valero", "gas"),
    (r"\bspeedway\b", "Speedway", "gas"), (r"\bcircle\s*k\b", "Circle K", "gas"), (r"\bwawa\b", "Wawa", "gas"), (r"\bsheetz\b", "Sheetz", "gas"),
    (r"\bmcdonald", "McDonald's", "restaurant"), (r"\bstarbucks\b", "Starbucks", "restaurant"), (r"\bsubway\b", "Subway", "restaurant"), (r"\bchipotle\b", "Chipotle", "restaurant"), (r"\bdoordash\b", "DoorDash", "restaurant"),
    (r"\bgrubhub\b", "Grubhub", "restaurant"), (r"\buber\s+eats\b", "Uber Eats", "restaurant"), (r"\btaco\s+bell\b", "Taco Bell", "restaurant"), (r"\bburger\s+king\b", "Burger King", "restaurant"),
    (r"\bpizza\s+hut\b", "Pizza Hut", "restaurant"), (r"\bdomino", "Domino's", "restaurant"), (r"\bpanera\b", "Panera Bread", "restaurant"), (r"\bdunkin", "Dunkin'", "restaurant"), (r"\bchick.fil.a\b", "Chick-fil-A", "restaurant"),
    (r"\bwendy", "Wendy's", "restaurant"), (r"\bpanda\s+express\b", "Panda Express", "restaurant"), (r"\bpostmates\b", "Postmates", "restaurant"), (r"\binstacart\b", "Instacart", "grocery"),
    (r"\buber\b", "Uber", "transport"), (r"\blyft\b", "Lyft", "transport"), (r"\be.?zpass\b", "E-ZPass", "transport"), (r"\bautozone\b", "AutoZone", "transport"), (r"\bjiffy\s+lube\b", "Jiffy Lube", "transport"),
    (r"\bnetflix\b", "Netflix", "subscription"), (r"\bhulu\b", "Hulu", "subscription"), (r"\bdisney\+?\b", "Disney+", "subscription"), (r"\bhbo\b|\bmax\b", "HBO Max", "subscription"), (r"\bparamount\+?\b", "Paramount+", "subscription"),
    (r"\bpeacock\b", "Peacock", "subscription"), (r"\bspotify\b", "Spotify", "subscription"), (r"\bmicrosoft\b", "Microsoft", "subscription"), (r"\badobe\b", "Adobe", "subscription"), (r"\bdropbox\b", "Dropbox", "subscription"),
    (r"\bnotion\b", "Notion", "subscription"), (r"\bopenai\b", "OpenAI", "subscription"), (r"\bchatgpt\b", "ChatGPT", "subscription"), (r"\banthropiccom\b|\banthropoic\b|\bAnthropic\b", "Anthropic", "subscription"),
    (r"\bzoom\b", "Zoom", "subscription"), (r"\bgithub\b", "GitHub", "subscription"),
    (r"\bcostco\b", "Costco", "shopping"), (r"\bhome\s+depot\b", "Home Depot", "shopping"), (r"\blowe'?s\b", "Lowe's", "shopping"), (r"\bbest\s+buy\b", "Best Buy", "shopping"), (r"\bikea\b", "IKEA", "shopping"),
    (r"\bwayfair\b", "Wayfair", "shopping"), (r"\bebay\b", "eBay", "shopping"), (r"\betsy\b", "Etsy", "shopping"), (r"\bkohl'?s\b", "Kohl's", "shopping"), (r"\btj\s+maxx\b", "TJ Maxx", "shopping"), (r"\bmarshalls\b", "Marshalls", "shopping"),
    (r"\bcvs\b", "CVS", "health"), (r"\bwalgreens\b", "Walgreens", "health"), (r"\brite\s+aid\b", "Rite Aid", "health"), (r"\blongs\s+drug\b", "Longs Drug", "health"), (r"\bplanet\s+fitness\b", "Planet Fitness", "health"),
    (r"\bla\s+fitness\b", "LA Fitness", "health"), (r"\bymca\b", "YMCA", "health"),
    (r"\bat&t\b", "AT&T", "utility"), (r"\bverizon\b", "Verizon", "utility"), (r"\bt.mobile\b", "T-Mobile", "utility"), (r"\bxfinity\b", "Xfinity", "utility"), (r"\bcomcast\b", "Comcast", "utility"), (r"\bspectrum\b", "Spectrum", "utility"),
    (r"\bairbnb\b", "Airbnb", "travel"), (r"\bmarriott\b", "Marriott", "travel"), (r"\bhilton\b", "Hilton", "travel"), (r"\bdelta\b", "Delta Air Lines", "travel"), (r"\bunited\s+air", "United Airlines", "travel"),
    (r"\bsouthwest\b", "Southwest Airlines", "travel"), (r"\bexpedia\b", "Expedia", "travel"), (r"\bbooking\.com\b", "Booking.com", "travel"),
    (r"\busaa\b", "USAA", "insurance"), (r"\bgeico\b", "GEICO", "insurance"), (r"\bstate\s+farm\b", "State Farm", "insurance"), (r"\ballstate\b", "Allstate", "insurance"), (r"\bprogressive\b", "Progressive", "insurance"),
    (r"\bdirect\s+dep", "Direct Deposit", "income"), (r"\bpayroll\b", "Payroll", "income"), (r"\bsalary\b", "Salary", "income"), (r"\bzelle\b", "Zelle", "transfer"), (r"\bvenmo\b", "Venmo", "transfer"),
    (r"\bpaypal\b", "PayPal", "transfer"), (r"\bcash\s+app\b", "Cash App", "transfer"),
]

# category, whether it is income, color, icon, master
CATEGORY_STYLES = [
    ("Food & Dining", False, "#f97316", "UtensilsCrossed", "FOOD"), ("Groceries", False, "#22c55e", "ShoppingCart", "GROCERY"), ("Housing", False, "#f59e0b", "Home", "HOME"), ("Transport", False, "#3b82f6", "Car", "TRANSPORT"),
    ("Entertainment", False, "#ec4899", "Film", "ENTERTAINMENT"), ("Shopping", False, "#f59e0b", "ShoppingBag", "SHOPPING"), ("Health", False, "#10b981", "HeartPulse", "HEALTH"), ("Utilities", False, "#6366f1", "Zap", "HOME"),
    ("Subscriptions", False, "#6366f1", "CreditCard", "DIGITAL"), ("Personal Care", False, "#f472b6", "Scissors", "PERSONAL_CARE"), ("Education", False, "#06b6d4", "BookOpen", "EDUCATION"), ("Travel", False, "#06b6d4", "Plane", "TRAVEL"),
    ("Insurance", False, "#64748b", "Shield", "FINANCIAL"), ("Fees & Charges", False, "#ef4444", "DollarSign", "FINANCIAL"), ("Gifts & Charity", False, "#8794ff", "Gift", "SOCIAL"), ("Income", True, "#16a34a", "TrendingUp", None),
    ("Transfer", False, "#64748b", "ArrowLeftRight", None), ("Transfers", False, "#64748b", "ArrowLeftRight", None), ("Other", False, "#94a3b8", "Package", None), ("Uncategorized", False, "#94a3b8", "Package", None),
    ("Fast Food", False, "#f97316", "Utensils", "FAST_FOOD"), ("Alcohol", False, "#8b5cf6", "Wine", "ALCOHOL"), ("Coffee", False, "#d97706", "Coffee", "COFFEE"), ("Restaurants", False, "#f97316", "UtensilsCrossed", "FOOD"),
    ("Gas/Fuel", False, "#3b82f6", "Zap", "TRANSPORT"), ("Gasoline/Fuel", False, "#3b82f6", "Zap", "TRANSPORT"), ("Cigarettes & Tobacco", False, "#78716c", "Ban", "TOBACCO"), ("Pets", False, "#a3e635", "PawPrint", "PETS"),
    ("Credit Card Payment", False, "#6366f1", "CreditCard", "FINANCIAL"),
]
# of a category without a style
PLAIN_STYLE = (False, "#94a3b8", "📦", None)


def rows(entries: list[tuple]) -> list[tuple]:
    """(word, *values) in order."""
    return [(word, *values) for *values, words in entries for word in words.split(",")]
