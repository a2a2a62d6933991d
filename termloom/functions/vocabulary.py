"""Vocabularies of the language, product-name and stage predicates.

All lists are fixed values; every predicate also takes a caller's own.
"""

#: Common English words, then words of the trade that are English.
ENGLISH = """
the be to of and a in that have i it for not on with he as you do at this but his by from they we say her she or an will my one all would
there their what so up out if about who get which go me when make can like time no just him know take people into year your good some could
them see other than then now look only come its over think also back after use two how our work first well way even new want because any
these give day most us is are was were been has had should must might
inspection inspect standard quality check ensure verify attach apply buffing cement primer stitch stitching sew needle upper sole outsole
midsole collar heel toe vamp lining temperature pressure duration machine device process operation defect clean surface guide manual safety
warning note step tools operator production specification prevent during placed placing position positioned aligned alignment molding shaping
hammering short even smooth wrinkles straight markers marking markings gauge last bottom size larger follow specifications lot die shift
tongue facing counter foxing mudguard overlay underlay insole foam rubber mesh leather textile knit tape film tpu eva phylon eyelet lace
thread seam adhesive heat press pass fail reject accept rework scrap line station stage target actual result status remark dirty tight loose
crooked bubble wrinkle crease crack tear burn stain glue oil dust width height thickness weight density hardness spi rpm psi bar deg sec min
hr hrs date month code
""".split()

#: Vietnamese syllables, without marks, that are hardly ever English words.
SYLLABLES = """
khong duoc nguoi nhung thiet huong trinh nguyen phom khuon quet chuyen xuong chuan thong thuat khoang nghieng chieu nhiet giay luoi chay thao
khac phuc giang nhanh cham thang lech dinh kiem ngan trung bung ghep rach xuat buoc truoc ngoai hoac biet thay giua duoi nhieu trong dung
tang giam canh vong diem doan bien luu chu yeu cau thuc hien dieu chinh thung mui dan mai keo lap nhan lon dap de got khau cuon xo cot vien
bao kho uot nong lanh loi mau hinh bam nham sut sup tuot quang meo nut khe bui ban sach luc gian trang tay ve sinh vua toi lang dao kim chiu
moc gioi han danh theo chua chong tran lem ho mo
""".split()

#: Vietnamese phrases in compact form (no marks, no spaces).
PHRASES = """
kiemtra thietbi vuilong truockhi vanhanh huongdan antoan khancap quytrinh sanxuat nguyenlieu mugiay dungmay chuy luuy yeucau thaotac thuchien
dieuchinh tieuchuan thongso kythuat quetkeo dande maide epde gomui gogot maylot mayvien hokeo trankeo botkhi supmi tuotmi dengoai degia
lotgiay matgiay vongco muigiay gotgiay duongmay muimay muikim nhietdo apluc thoigian khongduoc canphai tranhde dambao chieudai doday
khoangcach dobamdinh bannham doin inlogo khuontren khuonduoi khuondap daochat mangtpu mangbaove losay buongsay conghan totruong quandoc doivoi
apdungcho danhcho theomau maugiay hinhdan chieucao chieurong vetcat vetrach lemkeo dinhkeo khoangkeo dapnoi chaymay mayupper danoutsole
epnosew chayline kiemctq kiemisq datyeucau khongdat loikhuyettat bamdinh dandep maioutsole quettpu quetprimer longgot lechmui lechgot hoangmi
chongchay chongnut vattudauvao kiemhang donggoi dandecal gannhan xuatkho maymudguard maylogo maylot mayvongco mayde maymui mayrap maycup
maydrap may1kim may2kim mayzigzag
""".split()

#: Patterns of English phrases with a word that could be Vietnamese (JavaScript's ASCII word boundaries are written out).
HOMOGRAPHS = [
    r"may\s+(?:20\d{2}|\d{1,2}(?:st|nd|rd|th)?(?:\s*,\s*20\d{2}|\s+20\d{2}|$))",
    r"lot\s*(?:#|no\.?|number|id|code|size|qty)",
    r"day\s*(?:shift|off|time|work|\d+)",
    r"tan\s*(?:color|colour|leather|suede)",
    r"last\s*(?:step|check|operation|stage|process|inspection)",
]

#: Verbs and objects of the trade's commands, without marks, as patterns.
COMMAND_VERBS = r"may|dan|mai|quet|go|chat|ep|kiem\s*tra|dinh\s*hinh|ve\s*sinh"
COMMAND_OBJECTS = r"mudguard|logo|vien|lot|vong\s*co|de|mui|than|luoi|upper|outsole|midsole|heel|toe|collar|lining|tongue|strap|eyestay|label|jig|khuon|keo|primer|\d+\s*kim|zigzag|chi|rap|cup|drap"

#: Acronyms and marks that no language translates.
ACRONYMS = """
IPQC ISQ SPI CTQ QC QA QAM CAPA PFC SOP QMS ASTM PPM ERP MES OEE FMEA SPC TPU EVA PU RB LED UV N/A NA OK NG PASS FAIL ID NO NO. REV REV. STD
MM CM KG PSI BAR SEC MIN HR DEG P/O PO BOM CFM DEV PROD PLC USB WI-FI HTTP HTTPS TCP IP AC DC
""".split()

#: Brands; names of two words are written with a space.
BRANDS = [*"NIKE JORDAN CONVERSE VANS ADIDAS PUMA REEBOK ASICS".split(), "NEW BALANCE", "BALANCE", "CHING LUH", *"CHINGLUH HOKA SALOMON ON RUNNING BROOKS SAUCONY MIZUNO".split(), "UNDER ARMOUR", *"ARMOUR TIMBERLAND SKECHERS LI-NING ANTA FILA CROCS BIRKENSTOCK MERRELL".split()]

#: Words of model names: lines, silhouettes, other makers' lines, cuts and document tags.
MODEL_WORDS = """
SB ZOOM AIR MAX PRO RETRO FORCE DUNK PEGASUS VAPORMAX METCON REACT BLAZER INVINCIBLE VOMERO CORTEZ WAFFLE DOWNSHIFTER REVOLUTION STRUCTURE
WINFLO INFINITYRN INFINITY FLYKNIT FREE FLEX
NYJAH GIANNIS FREAK LEBRON KOBE PROTRO KD JA BOOK SABRINA LUKA TATUM ZION GT CUT JUMP VAPORFLY ALPHAFLY STREAKFLY TIEMPO MERCURIAL PHANTOM
CHUCK TAYLOR ALL-STAR ONE-STAR SK8-HI OLD-SKOOL
CPFM FLEA KAYANO NIMBUS GEL BONDI CLIFTON SPEEDGOAT XT-6 GHOST ADRENALINE SAMBA GAZELLE CAMPUS STAN SMITH ULTRABOOST SUPERSTAR SUEDE
LOW MID HIGH OG SE QS SP NRG PRM PREMIUM PLUS FA24 FA25 FA26 SP24 SP25 SP26 SU24 SU25 SU26 HO24 HO25 HO26 SAMPLE STAGE CFM DEV PROD QA ISQ
IPQC SOP MANUAL MODEL STYLE COLOR COLORWAY CODE REV ROUND SPEC
""".split()

#: One of these makes a text a candidate for a model name (a pattern).
MODEL_SIGNS = r"NIKE|JORDAN|CONVERSE|VANS|ADIDAS|PUMA|REEBOK|ASICS|NEW\s*BALANCE|CHING\s*LUH|HOKA|SALOMON|ON|BROOKS|SAUCONY|MIZUNO|UNDER\s*ARMOUR|TIMBERLAND|SKECHERS|LI-NING|ANTA|AIR\s*FORCE|AIR\s*MAX|ZOOM|PEGASUS|VOMERO|METCON|BLAZER|DUNK|NYJAH|LEBRON|KOBE|GIANNIS|VAPORMAX|FREE\s*METCON|INVINCIBLE|INFINITYRN|KAYANO|NIMBUS|GEL|BONDI|CLIFTON|SPEEDGOAT|XT-6|GHOST|ADRENALINE|SAMBA|GAZELLE|STAN\s*SMITH|ULTRABOOST|CPFM|FLEA"

#: Stages of manufacturing with their words, as patterns, in order.
STAGES = [
    ("nosew", r"nosew|no-sew|ép\s+nhiệt|máy\s+nosew|pizza\s+pan|protective\s+film|màng\s+tpu|màng\s+bảo\s+vệ"),
    ("stitching", r"may|đường\s+may|kim|chỉ|mũi/inch|spi|mudguard|collar\s+lining|may\s+lót|may\s+vòng\s+cổ"),
    ("cutting", r"chặt|dao\s+chặt|khuôn\s+dao|máy\s+chặt|cắt\s+laser|bàn\s+chặt"),
    ("assembly", r"gò|dán\s+đế|quét\s+keo|quét\s+primer|sấy|lò\s+sấy|lực\s+ép\s+đế|ép\s+lạnh|ép\s+nóng|last|lasting"),
    ("stockfit", r"mài\s+đế|xử\s+lý\s+đế|phun\s+sơn\s+đế|đế\s+ngoài|outsole|midsole|stockfit"),
    ("qa", r"kiểm\s+tra|lỗi|khuyết\s+tật|defect|ctq|isq|tiêu\s+chuẩn|qa\s+manual|mức\s+độ|ẩn\s+màu|lem\s+màu"),
]

#: Units beside which a dash or slash parts a measure, not two languages.
UNIT_WORDS = "inch inches cm mm m kg g spi sec min hr hour hours bar psi rpm prs pair pairs deg degree c f cm2 cm² m2 m² kg/cm² m/s lỗ mũi".split()

#: Parts of a shoe, in Vietnamese and in English.
COMPONENTS_VI = ["mũi giày", "gót giày", "mũi", "gót", "vòng cổ", "lưỡi gà", "lưỡi", "má trong", "má ngoài", "đế giữa", "đế ngoài", "lót giày", "cúp gót", "mudguard", "eyestay", "vamp"]
COMPONENTS_EN = ["tip quarter", "heel counter", "collar", "tongue", "vamp", "eyestay", "outsole", "midsole", "sockliner", "mudguard", "quarter", "tip", "heel", "lining", "collar lining", "toe cap", "strobel board"]
#: Defects that an instruction lists.
DEFECTS = ["đứt chỉ", "nổi chỉ", "bỏ mũi", "lệch", "nhảy chỉ", "hở keo", "lem keo", "tràn keo", "thiếu keo", "nhăn", "trề biên", "lộn chân", "bấp bênh", "mài cao", "biến dạng", "khác màu", "bọt khí", "sụp mí", "lệch mí", "lệch tâm", "xơ chỉ"]
#: What stands for a defect or a part in English.
DEFECTS_EN = {
    "đứt chỉ": ["broken thread", "thread break", "snapped stitch"], "nổi chỉ": ["loose thread", "raised thread", "thread pull"],
    "bỏ mũi": ["skip stitch", "missed stitch", "skipped stitch"], "lệch": ["misalign", "offset", "uneven", "crooked"],
    "nhảy chỉ": ["skip stitch", "skipped stitch"], "hở keo": ["bond gap", "open glue", "delamination"],
    "lem keo": ["cement smear", "glue stain", "cement overflow"], "tràn keo": ["cement overflow", "excess cement", "glue flashing"],
    "thiếu keo": ["lack of cement", "insufficient cement", "starved glue"], "nhăn": ["wrinkle", "crease", "pucker", "fold"],
    "trề biên": ["flashing", "edge overflow", "material overflow"], "sụp mí": ["collapsed seam", "dropped stitch", "run-off"],
    "lệch mí": ["seam misalignment", "misaligned edge"], "bọt khí": ["air bubble", "blister", "void"],
}
COMPONENTS_AS_EN = {
    "mũi giày": ["vamp", "toe", "tip"], "mũi": ["tip", "toe", "vamp"], "gót giày": ["heel"], "gót": ["heel"], "vòng cổ": ["collar", "neckline", "opening"],
    "lưỡi gà": ["tongue"], "lưỡi": ["tongue"], "đế giữa": ["midsole"], "đế ngoài": ["outsole"], "lót giày": ["sockliner", "insole"], "cúp gót": ["heel counter"],
    "má trong": ["medial"], "má ngoài": ["lateral"],
}
#: Standards that instructions name, as patterns.
STANDARDS = [r"PFC", r"QA[-\s]?manual", r"SOP", r"ISO\s*\d+", r"QC", r"CTQ", r"IPQC", r"ISQ"]

#: English words that count as evidence of the language.
EVIDENCE_WORDS = """
emergency stop shutdown safety instructions inspection inspect quality control procedure production process material upper needle detection
standard equipment machine device check operate operation report final use please open close start maintenance before after ensure test press
button warning remove clean cutting stitch shape toe heel collar buffing cement apply attach spray tension prepare operator must should good
reject defect critical measurement record door valve switch power off on instruction unexpected english note slide step tools sew sole panel
lining assembly hot cool last lasting fit verify feed position set adjust select install replace handling temperature specification manual
prevent during work wear protection
""".split()

#: Vietnamese phrases that count as evidence, and whose spelling is mended where marks are wrong or missing.
EVIDENCE_PHRASES = [
    "kiểm tra", "thiết bị", "vui lòng", "trước khi", "vận hành", "hướng dẫn", "an toàn", "khẩn cấp", "quy trình", "sản xuất", "nguyên liệu", "mũ giày",
    "dừng máy", "chú ý", "lưu ý", "yêu cầu", "thao tác", "thực hiện", "điều chỉnh", "tiêu chuẩn", "thông số", "kỹ thuật", "quét keo", "dán đế", "mài đế",
    "ép đế", "gò mũi", "gò gót", "may lót", "may viền", "hở keo", "tràn keo", "bọt khí", "sụp mí", "đế ngoài", "đế giữa", "lót giày", "mặt giày",
    "vòng cổ", "mũi giày", "gót giày", "đường may", "mũi may", "mũi kim", "nhiệt độ", "áp lực", "thời gian", "không được", "cần phải", "đối với",
    "áp dụng cho", "dành cho", "theo mẫu", "mẫu giày", "chất lượng", "khuyết tật",
]

#: Words of sample cards.
METADATA = "NIKE ZOOM AIR MAX PLUS PRO RETRO FORCE DUNK SAMPLE STAGE CFM DEV PROD PASS FAIL OK NG DATE MODEL REV ROUND CONFIRM STATUS SPEC CODE SIZE QTY".split()

#: English words that say nothing about whether two texts belong together.
WEAK_WORDS = """
the a an and or of to in on at by for with is are was were be been that this it not no as if from into than then its all any both each such
inspection focuses focus strategy standard standards manual procedure process stage title sop qa qc ipqc oqc ctq
check checking inspect inspecting use using make sure adjust adjusting need needed conduct conducted follow following before after
operator operation method result results item items line lines have has had will would can could should must
""".split()
