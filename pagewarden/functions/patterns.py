"""Signature library: the pattern texts and small tables the rules need.

Everything in this file is a fixed value: results depend on these texts being
exactly these.  Patterns are written for Java regular expressions and are used
with the flags ``(?iu)``; white space and digits are spelt out where Unicode
classes matter (see :data:`SPACE`).
"""

from __future__ import annotations

# --- fixed values: signature patterns -------------------------------------------------------
RX_GAMB_STRONG = (r'kasino|kasyno|kasyna|cazino|cassino|casinò|kazino|казино|ставки на спорт|赌场|赌博|博彩|网赌|娱乐城|百家乐|太阳城|菠菜|六合彩|彩票|'
    r'카지노|바카라|먹튀|토토사이트|토토|슬롯|คาสิโน|บาคาร่า|สล็อต|เว็บพนัน|แทงบอล|カジノ|オンラインカジノ|パチンコ|ブックメーカー|'
    r'\bjudi\b|judi online|judi bola|situs judi|situs slot|situs toto|slot online|slot gacor|slot-gacor|slot88|slot777|slot deposit|mpo slot|qq ?slot|pkv games|\bpkv\b|'
    r'togel|toto macau|toto hk|toto sgp|toto sdy|toto 4d|bandar togel|bandar judi|bandar bola|\bgacor\b|maxwin|rtp slot|rtp live|sbobet|bocoran|taruhan|link alternatif|'
    r'deposit pulsa|bonus new member|scatter hitam|daftar slot|link slot|sabung ayam|\bsabong\b|mahjong ways|gates of olympus|pragmatic play|pg ?soft|joker123|918kiss|'
    r'pussy888|mega888|maxbet|\bbahis\b|bahsegel|bahis siteleri|bahis giriş|casino siteleri|\bbettilt\b|apuestas deportivas|apostas esportivas|tragamonedas|tragaperras|'
    r'caça-níqueis|scommesse|nhà cái|nha cai|nổ hũ|\bno hu\b|đá gà|\bda ga\b|cá cược|\bca cuoc\b|सट्टा|कैसीनो|जुआ|1xbet|melbet|betwinner|betvisa|\bpin-?up\b|parimatch|'
    r'mostbet|4rabet|babu ?88|baji ?(live|88|999|bet|bd)|bajilive|krikya|jeetbuzz|jeetwin|jaya9|nagad88|glory casino|marvelbet|mcw casino|crickex|linebet|9wickets|'
    r'rajabets|bet365|betobet|vavada|1win|bbrbet')
RX_GAMB_WEAK = r'\bcasino\b|\bpoker\b|\bbetting\b|\bslots\b|gambling|jackpot|\bbaccarat\b|\broulette\b|sportsbook|wagering|sweepstakes|\bbet now\b'
RX_PHARMA_STRONG = r'kamagra|sildenafil|tadalafil|vardenafil|lovegra|\bviagra\b|\bcialis\b|\blevitra\b|伟哥|comprar viagra|generic viagra|buy viagra|cheap cialis|farmacia online'
RX_PHARMA_WEAK = r'erectile dysfunction|\bed pills\b|penis enlargement'
RX_ADULT_STRONG = r'\bbokep\b|\bhentai\b|av女优|福利视频|情色片|秘密福利视频|\bporn\b|pornhub|xvideos|\bxnxx\b|\bsikiş\b|\bsikis\b'
RX_ADULT_WEAK = r'\bescort\b|\bxxx\b|sex video|sex tube|escort service'
RX_DEFACE = r'hacked by|defaced by|h4cked|\bhak3d\b|pwned by|owned by .{0,20}team|greetz to|defacer\.id|gantengers|\bg4nteng\b|was here by|\bmr\.?[a-z0-9]+ team\b'

RX_MALJS = r'defacer\.id|cdn-fileserver\.com|l\.cdn-fileserver|jso\.[a-z0-9.]+\.id|if\(ndsw|[;{ ]ndsw[ =.:]|\bndsx\b|\bndsj\b|COOKIE_ANNOT'
RX_WAF = (r'Just a moment\.\.\.|Checking your browser before|challenges\.cloudflare\.com|cf-browser-verification|_cf_chl_opt|Verifying you are human|'
    r'Enable JavaScript and cookies to continue|sucuri_cloudproxy|Sucuri WebSite Firewall|Incapsula incident ID|ddos-guard|StackPath')

RX_JUNKTLD = r'\.(ru|cn|tk|ml|ga|cf|gq|top|xyz|icu|club|live|cyou|sbs|online|shop|fun|monster|click|rest|quest|bet|casino|vip|cc|buzz|work|men|loan)([/:?#]|$)'

RX_SLUG_SPAM = (r'situs|\bjudi\b|togel|\bgacor\b|maxwin|sbobet|\bpkv\b|slot-?(gacor|online|88|777|deposit)|sabung-?ayam|bahis(siteleri|giris)?|918kiss|pussy888|mega888|'
    r'mahjong-?ways|pragmatic-?play|joker123|toto-?(macau|hk|sgp|4d|sdy)')
FOREIGN = r'[぀-ヿ㐀-鿿Ѐ-ӿ฀-๿가-힣]'
SPAMMY_DOMAIN = (
    r'casino|cassino|kasino|kasyno|kazino|cazino|slot|togel|toto|judi|gacor|maxwin|sbobet|bocoran|'
    r'1xbet|melbet|betwinner|mostbet|mostplay|parimatch|4rabet|jeetbuzz|jeetwin|jeetbaji|betvisa|bettilt|'
    r'glorycasino|marvelbet|crickex|linebet|pussy888|mega888|joker123|918kiss|bandartogel|'
    r'baji|babu88|krikya|jaya9|nagad88|smilebet|jilibet|fancywin|crazytime|khelabet|betbuzz|'
    r'bet365|22bet|dafabet|fun88|1win|rajabets|pinup|pin-up|stake\.|wagering|'
    r'pornhub|xvideos|xnxx|sexcam|escortservice')
SPAMMY_TLD = r'\.(bet|casino|poker|porn|sex|xxx|adult)$'
# Letters that show regional identity, and business categories with their order of preference.
BENGALI = r'[ঀ-৿]'
CATS = [
    ("healthcare", r'\b(hospital|clinic|medical|healthcare|health|diagnostic|dental|dentist|ortho|cardiac|surgeon|doctor|physiotherapy|laborator|pathology|maternity|homeo|nursing home|gyna?e)\b|হাসপাতাল|ক্লিনিক|চিকিৎসা|ডায়াগনস্টিক|ডেন্টাল|স্বাস্থ্য'),
    ("education", r'\b(school|college|university|institute|academy|madrasah?|coaching|kindergarten|polytechnic|tutorial|education|e-learning|admission|syllabus|scholarship)\b|স্কুল|কলেজ|বিশ্ববিদ্যালয়|মাদ্রাসা|কোচিং|শিক্ষা|একাডেমি'),
    ("ecommerce", r'\b(shop|store|mart|bazar|bazaar|online shopping|checkout|deals|order now|free delivery|cash on delivery|wholesale|retail|gadget|fashion|lifestyle)\b|দোকান|কেনাকাটা|অনলাইন শপ|বাজার|অর্ডার|ডেলিভারি|পাইকারি'),
    ("garments", r'\b(garments|textile|apparel|knit|knitwear|woven|sweater|denim|fabric|spinning|dyeing|rmg|buying house|mills|industries|manufacturer)\b|গার্মেন্টস|টেক্সটাইল|পোশাক|কারখানা|শিল্প'),
    ("realestate", r'\b(real ?estate|property|properties|developers?|apartment|flat|housing|plot|builders|construction|infrastructure|holdings)\b|রিয়েল এস্টেট|আবাসন|ফ্ল্যাট|প্লট|জমি|নির্মাণ'),
    ("food", r'\b(restaurant|cafe|kitchen|biryani|biriyani|kabab|kebab|fast food|catering|bakery|sweets|hotel|resort|motel|guest house|banquet|buffet|cuisine)\b|রেস্টুরেন্ট|খাবার|বিরিয়ানি|বেকারি|হোটেল|রিসোর্ট'),
    ("finance", r'\b(bank|banking|finance|financial|insurance|micro(?:finance|credit)|nbfi|leasing|investment|capital|securities|brokerage|mutual fund|remittance)\b|ব্যাংক|অর্থায়ন|বীমা|ঋণ|বিনিয়োগ'),
    ("it", r'\b(software|technolog|web development|app development|digital agency|saas|cloud|hosting|erp|cyber|fintech|developers?|solutions|systems)\b|সফটওয়্যার|প্রযুক্তি|ওয়েব|অ্যাপ|ডিজিটাল'),
    ("ngo", r'\b(ngo|foundation|charity|charitable|trust|welfare|relief|humanitarian|non-?profit|orphanage|zakat|samit[iy])\b|ফাউন্ডেশন|কল্যাণ|সমিতি|সংস্থা|ট্রাস্ট'),
    ("travel", r'\b(travels?|tours?|tourism|holiday|air ticket|ticketing|visa|hajj|umrah|pilgrimage|tour operator|iata|manpower)\b|ট্রাভেল|ভ্রমণ|পর্যটন|হজ|ওমরাহ|ভিসা'),
    ("news", r'\b(news|news24|daily|bulletin|times|tribune|press|media|magazine|journal|television|channel|broadcast|breaking news|editorial)\b|সংবাদ|খবর|দৈনিক|পত্রিকা|মিডিয়া|চ্যানেল'),
    ("government", r'\b(government|govt|ministry|directorate|municipality|city corporation|union parishad|upazila|commission|authority|bureau)\b|সরকার|মন্ত্রণালয়|অধিদপ্তর|পৌরসভা'),
    ("agro", r'\b(agro|agricultur|farms?|nursery|seeds?|fertilizer|pesticide|poultry|dairy|fisheries|hatchery|livestock|shrimp)\b|কৃষি|এগ্রো|খামার|বীজ|পোল্ট্রি|মৎস্য'),
    ("pharma", r'\b(pharmaceuticals?|pharma|pharmacy|medicine|drugs?|laboratories|formulation|gmp|vaccine)\b|ফার্মা|ঔষধ|ওষুধ|ফার্মেসি'),
    ("automobile", r'\b(automobiles?|motors|vehicles?|motorcycle|truck|transport|logistics|courier|rent-?a-?car|spare parts|garage|dealership|automotive)\b|অটোমোবাইল|মোটরস|গাড়ি|পরিবহন'),
    ("professional", r'\b(consult(?:ing|ancy|ants)?|law firm|advocate|chambers|legal|audit|chartered accountant|advisory|marketing|advertising|branding|architects|interior|recruitment|traders?|import|export|enterprise|corporation|group)\b|কনসালট্যান্ট|অডিট'),
]
PRIORITY = ["government", "education", "ngo", "finance", "pharma", "healthcare", "news", "travel",
            "garments", "agro", "automobile", "realestate", "food", "ecommerce", "it", "professional"]


# --- fixed values: unions of the signatures ---------------------------------------------------
ALL_STRONG = "(?:%s)|(?:%s)|(?:%s)" % (RX_GAMB_STRONG, RX_PHARMA_STRONG, RX_ADULT_STRONG)
ALL_WEAK = "(?:%s)|(?:%s)|(?:%s)" % (RX_GAMB_WEAK, RX_PHARMA_WEAK, RX_ADULT_WEAK)
BD_PHONE = r"(?:\+?880|\b0)1[3-9]\p{Nd}{8}\b"

# --- fixed values: hosts that are never harvested, and infrastructure ------------------------
BLOCKED_DOMAINS = """facebook.com fb.com fb.me google.com gmail.com googleusercontent.com youtube.com youtu.be
instagram.com linkedin.com twitter.com x.com wa.me whatsapp.com t.me telegram.me telegram.org bit.ly
tinyurl.com goo.gl maps.google.com play.google.com apple.com microsoft.com yahoo.com hotmail.com
outlook.com live.com w3.org schema.org gravatar.com wordpress.org wordpress.com gstatic.com
googleapis.com google-analytics.com cloudflare.com jsdelivr.net jquery.com bootstrapcdn.com
fontawesome.com example.com domain.com wixsite.com blogspot.com pinterest.com tiktok.com
mail.google.com drive.google.com sites.google.com googletagmanager.com gmpg.org amazonaws.com
cloudfront.net akamai.net fastly.net bunny.net daraz.com.bd bikroy.com""".split()
BLOCKED_PARTS = (
    "facebook.", "fb.com", "fb.me", "instagram.", "twitter.", "x.com",
    "linkedin.", "youtube.", "youtu.be", "wa.me", "whatsapp.", "t.me",
    "telegram.", "pinterest.", "tiktok.", "google.", "goo.gl", "maps.app",
    "g.page", "bit.ly", "tinyurl.", "gravatar.", "wp.com", "w.org",
    "wordpress.org", "gstatic.", "googleapis.", "doubleclick.",
    "schema.org", "example.com", "cloudflare", "jsdelivr.", "unpkg.",
    "fontawesome.", "bootstrapcdn.", "jquery.", "gmpg.org", "yoast.com",
    "cdninstagram.", "fbcdn.", "ggpht.",
)
CDN_PREFIXES = ("104.21.", "172.67.", "104.16.", "104.17.", "104.18.", "104.19.",
                "172.64.", "172.65.", "172.66.", "188.114.", "162.159.", "104.26.",
                "104.27.", "104.28.", "151.101.", "199.232.")
HOST_PROVIDERS = {
    "dhakacom.com", "link3.net", "exonhost.com", "webhostbd.com", "hostever.com",
    "bdwebservices.com", "alpha.net.bd", "aamranetworks.com", "bdcom.com", "adnsl.net",
    "cloudflare.com", "hostinger.com", "namecheap.com", "godaddy.com", "bluehost.com",
    "amazonaws.com", "digitalocean.com", "googleusercontent.com", "hostgator.com",
    "siteground.com", "cpanel.net", "litespeedtech.com", "hostnetbd.com", "sslwireless.com",
    "web-hosting.com", "websitewelcome.com", "registrar-servers.com", "hostgator.com.bd",
}
SECOND_LEVEL = ("com", "gov", "edu", "org", "net", "ac", "mil", "info", "co")

# --- fixed values: places for addresses ------------------------------------------------------
DISTRICTS = ["Dhaka","Gazipur","Narayanganj","Narsingdi","Manikganj","Munshiganj","Tangail","Kishoreganj","Faridpur","Gopalganj","Madaripur","Shariatpur","Rajbari","Chattogram","Chittagong","Cox's Bazar","Coxs Bazar","Cumilla","Comilla","Brahmanbaria","Chandpur","Feni","Lakshmipur","Noakhali","Khagrachhari","Rangamati","Bandarban","Sylhet","Moulvibazar","Habiganj","Sunamganj","Rajshahi","Bogura","Bogra","Pabna","Sirajganj","Natore","Naogaon","Joypurhat","Chapainawabganj","Khulna","Jashore","Jessore","Satkhira","Bagerhat","Jhenaidah","Magura","Narail","Kushtia","Chuadanga","Meherpur","Barishal","Barisal","Bhola","Patuakhali","Pirojpur","Barguna","Jhalokati","Rangpur","Dinajpur","Thakurgaon","Panchagarh","Nilphamari","Lalmonirhat","Kurigram","Gaibandha","Mymensingh","Jamalpur","Sherpur","Netrokona"]
AREAS = ["Mirpur","Pallabi","Kazipara","Shewrapara","Kafrul","Agargaon","Mohammadpur","Shyamoli","Adabor","Dhanmondi","Lalmatia","Gulshan","Banani","Baridhara","Bashundhara","Badda","Rampura","Khilgaon","Motijheel","Paltan","Segunbagicha","Malibagh","Moghbazar","Mohakhali","Tejgaon","Farmgate","Karwan Bazar","Kawran Bazar","Panthapath","Uttara","Khilkhet","Mugda","Jatrabari","Demra","Old Dhaka","Lalbagh","Wari","Kamrangirchar","Savar","Keraniganj","Tongi","Gabtoli","Mirpur DOHS","Banasree","Aftabnagar","Cantonment","Eskaton","Bijoy Nagar","Bangla Motor","Shantinagar","New Market","Elephant Road","Green Road","Shahbagh","Hazaribagh","Azimpur","Shahjadpur","Vatara","Kuril","Nadda"]

# --- fixed values: layer weights (detection rate, false-positive rate) -----------------------
PRIOR = 0.12
WEIGHTS = {
    "L1KW_STRONG": (0.80, 0.030), "L1KW_WEAK": (0.55, 0.120), "L10LANG": (0.45, 0.080),
    "L17HIDDEN": (0.85, 0.010),
    "L2UACLOAK": (0.92, 0.020), "L3REFCLOAK": (0.90, 0.020),
    "L12IPCLOAK": (0.95, 0.005), "L13INNERCLOAK": (0.93, 0.005),
    "L11REST": (0.88, 0.010), "L16FEED": (0.80, 0.020), "L20SCRIPT": (0.82, 0.020),
    "L20MASS": (0.40, 0.050),
    "L11SITEMAP": (0.78, 0.020), "L20SHAPE": (0.80, 0.020),
    "L5DENSITY": (0.70, 0.050),
    "L4MOBILE": (0.75, 0.040), "L9REDIR": (0.70, 0.060), "L16HDR": (0.80, 0.030),
    "L20RELAY": (0.50, 0.050),
    "L14CAMPAIGN": (0.97, 0.002), "L14OBFUS": (0.60, 0.030), "L8IFRAME": (0.85, 0.010),
    "L19SHELL": (0.95, 0.003),
    "L15SURBL": (0.85, 0.020), "L15DBL": (0.88, 0.020), "L15URLHAUS": (0.95, 0.003),
    "L15CT": (0.60, 0.030), "L15GSB": (0.95, 0.003),
    "L10DEFACE": (0.97, 0.002),
}
UNKNOWN_WEIGHT = (0.55, 0.10)
HARD_LAYERS = ("L14CAMPAIGN", "L19SHELL", "L15URLHAUS", "L15GSB", "L10DEFACE")
EXTERNAL_LAYERS = ("L15SURBL", "L15DBL", "L15URLHAUS", "L15CT", "L15GSB")
LAYER_CATEGORY = {
    "L2UACLOAK": "cloak", "L3REFCLOAK": "cloak", "L12IPCLOAK": "cloak", "L13INNERCLOAK": "cloak",
    "L4MOBILE": "redirect", "L9REDIR": "redirect", "L16HDR": "redirect", "L20RELAY": "redirect",
    "L10DEFACE": "deface", "L14CAMPAIGN": "malware", "L14OBFUS": "malware", "L8IFRAME": "malware", "L19SHELL": "malware",
    "L10LANG": "foreign_lang", "L20SCRIPT": "foreign_lang",
}
STEALTH_LAYERS = ("L2UACLOAK", "L3REFCLOAK", "L12IPCLOAK", "L13INNERCLOAK", "L17HIDDEN", "L20RELAY", "L16HDR")
MALWARE_LAYERS = ("L14CAMPAIGN", "L8IFRAME", "L10DEFACE", "L19SHELL")
DOORWAY_LAYERS = ("L11REST", "L11SITEMAP", "L5DENSITY", "L16FEED", "L20SHAPE", "L20SCRIPT")
RECHECK_STRONG_LAYERS = ("L11REST", "L11SITEMAP", "L2UACLOAK", "L3REFCLOAK", "L12IPCLOAK", "L13INNERCLOAK", "L17HIDDEN",
                         "L10DEFACE", "L14CAMPAIGN", "L8IFRAME", "L19SHELL", "L5DENSITY", "L16FEED", "L20SCRIPT", "L20SHAPE",
                         "L16HDR", "L20RELAY")
CATEGORIES = ("gambling", "pharma", "adult", "deface", "cloak", "foreign_lang", "malware", "redirect")

# --- fixed values: character classes that Python's Unicode matching implies ------------------
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
