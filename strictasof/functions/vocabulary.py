"""Stored texts and codes that must equal the source data's own."""

# entry statuses
FINISHED = ("出走", "降着")
STOPPED = ("競走中止", "失格")
VOID = ("出走取消", "競走除外")
RAN = FINISHED + STOPPED
ALL_STATUSES = RAN + VOID
RELEGATED = "降着"

# finish-column markers of a result page
FINISH_MARKERS = {"中": "競走中止", "除": "競走除外", "取": "出走取消", "失": "失格"}

# distance bands: upper bound (inclusive) and name, then the name above the last bound
DISTANCE_BANDS = ((1400, "短距離"), (1800, "マイル"), (2200, "中距離"))
LONGEST_BAND = "長距離"

# months of each season; the remaining months are winter
SEASONS = {"春": (3, 4, 5), "夏": (6, 7, 8), "秋": (9, 10, 11)}
WINTER = "冬"

# track condition as an ordinal
TRACK_CONDITION_CODES = {"良": 0, "稍重": 1, "重": 2, "不良": 3}
# one-character condition of an entry card
TRACK_CONDITION_SHORT = {"良": "良", "稍": "稍重", "重": "重", "不": "不良"}

# margin words, in lengths
MARGIN_WORDS = {"ハナ": 0.05, "アタマ": 0.1, "クビ": 0.2, "大": 10.0, "同着": 0.0}

# home courses of each stable
HOME_COURSES = {
    "東": ("東京", "中山", "新潟", "福島", "札幌", "函館"),
    "西": ("阪神", "京都", "中京", "小倉"),
}

# grades as printed and as stored
GRADES = {
    "GI": "G1", "GII": "G2", "GIII": "G3",
    "JpnI": "Jpn1", "JpnII": "Jpn2", "JpnIII": "Jpn3",
    "L": "L", "重賞": "重賞",
}
GRADE_ICONS = {"1": "G1", "2": "G2", "3": "G3"}
FLAGGED_GRADE = "G1"

RACE_CLASSES = ("新馬", "未勝利", "1勝クラス", "2勝クラス", "3勝クラス", "オープン")
LADDER_CLASSES = (
    "A1", "A2", "B1", "B2", "B3", "C1", "C2", "C3",
    "A1A2", "A2B1", "B1B2", "B2B3", "B3C1", "C1C2", "C2C3",
)
WEIGHT_RULES = ("馬齢", "定量", "別定", "ハンデ")
SURFACES = ("芝", "ダート", "障害")
DIRECTIONS = ("右", "左", "直線")
AFFILIATIONS = ("東", "西", "地", "外")
AFFILIATION_LABELS = {"美浦": "東", "栗東": "西"}
OTHER_CLASS = "その他"

# ticket types
WIN, PLACE, WIDE = "単勝", "複勝", "ワイド"
LEDGER_TYPES = (WIN, PLACE, WIDE)
FRAME_TYPES = ("枠連", "枠単")
UNORDERED_TYPES = ("枠連", "馬連", "ワイド", "三連複")
ORDERED_TYPES = ("馬単", "三連単", "枠単")

# combination types of the probability operators
QUINELLA, EXACTA, TRIO, TRIFECTA = "馬連", "馬単", "3連複", "3連単"

# route name -> timings it may use
ROUTE_TIMINGS = {"暫定": ("水曜", "木曜"), "本命": ("水曜", "木曜", "当日")}
SAME_DAY = "当日"
SAME_DAY_DEADLINE_MINUTES = 15

# page table headings
H_FINISH, H_NUMBER, H_FRAME, H_HORSE, H_SEX_AGE = "着順", "馬番", "枠番", "馬名", "性齢"
H_CARRIED, H_JOCKEY, H_TIME, H_MARGIN, H_PASSAGE = "斤量", "騎手", "タイム", "着差", "通過"
H_LAST_3F, H_ODDS, H_POPULARITY, H_BODY_WEIGHT = "上り", "単勝", "人気", "馬体重"
H_TRAINER, H_OWNER, H_PRIZE = "調教師", "馬主", "賞金(万円)"

# classes, labels and link folders of the stored pages
RESULT_TABLE, PAYOUT_TABLE, PEDIGREE_TABLE, CARD_TABLE = "race_table_01", "pay_table_01", "blood_table", "Shutuba_Table"
EVENT_BLOCK, SMALL_LINE, VENUE_HEAD = "racedata", "smalltxt", "race_top_hold_data"
CARD_EVENT, CARD_NUMBER, CARD_TITLE, CARD_INFO, CARD_DETAILS = "RaceList_Item02", "RaceNum", "RaceName", "RaceData01", "RaceData02"
CARD_ROW, CARD_HORSE, CARD_SEX_AGE, CARD_TRAINER, CARD_WEIGHT = "HorseList", "HorseName", "Barei", "Trainer", "Weight"
L_WEATHER, L_TURF, L_DIRT, L_TRACK, L_START, L_LAP_TABLE, L_LAP, L_CORNERS = "天候", "芝", "ダート", "馬場", "発走", "ラップタイム", "ラップ", "コーナー通過順位"
K_EVENT, K_HORSE, K_JOCKEY, K_TRAINER, K_OWNER = "race", "horse", "jockey/result/recent", "trainer/result/recent", "owner/result/recent"
SURFACE_MARKS = {"芝": "芝", "ダ": "ダート"}
LADDER_VENUE, LADDER_WORDS = "大井", ("新馬", "オープン")

# listing pages: known venues, section headings, mark of jump events
VENUE_CODES = tuple(f"{i:02d}" for i in range(1, 11))
SECTION_CENTRAL, SECTION_LOCAL, JUMP_MARK = "中央", "地方", "障"

# rows that a parent and a grandparent span in the pedigree table
PARENT_ROWS, GRANDPARENT_ROWS = 16, 8
