"""Fictional ruled ledger pages for tests; "~" around text marks it as struck."""
from pyspark.sql import functions as F

from shirube.functions.cells import flags_from_marks

RULE = "┠────────────┨"


def row(*cells):
    return "┃" + "│".join(cells) + "┃"


def block(*parts):
    """Records of one box; each part is a row (tuple) or a list of rows that belong together."""
    lines = ["┏━━━━━━━━━━━━┓"]
    for part in parts:
        rows = part if isinstance(part, list) else [part]
        lines += [row(*r) for r in rows] + [RULE]
    return lines[:-1] + ["┗━━━━━━━━━━━━┛"]


def lines_df(spark, documents):
    """documents: {file_hash: [page lines, ...]} to the line table."""
    data = [(name, page_no, line_no, text) for name, pages in documents.items()
            for page_no, page in enumerate(pages, 1) for line_no, text in enumerate(page)]
    df = spark.createDataFrame(data, "file_hash string, page_no int, line_no int, marked string")
    return df.select("file_hash", "page_no", "line_no", F.replace("marked", F.lit("~"), F.lit("")).alias("text"), flags_from_marks(F.col("marked")).alias("flags"))


TITLE = ("順位番号", "登記の目的", "受付年月日・受付番号", "権利者その他の事項")
A_HEAD = ("　権　利　部　（　甲　区　）",)
B_HEAD = ("　権　利　部　（　乙　区　）",)

CONDO = (
    block(("　表　題　部　（一棟の建物の表示）", "調製"),
          ("所　在", "海区見本二丁目　７番地１、７番地２　", ""),
          ("建物の名称", "見本ハイツ", ""),
          ("①　構　造", "②　床　面　積　㎡", "原因"),
          [("鉄骨造陸屋根２階建", "１階　１２０：４０", "〔平成２年〕"), ("", "２階　　９９：０５", "")],
          ("　表　題　部　（敷地権の目的である土地の表示）",),
          ("①土地の符号", "②所在及び地番", "③地目", "④地積　㎡", "登記の日付"),
          ("１", "海区見本二丁目７番１", "宅地", "２１０：００", "平成２年"),
          ("２", "海区見本二丁目７番２", "宅地", "　４０：２５", "平成２年"))
    + block(("　表　題　部　（専有部分の建物の表示）", "番号"),
            ("家屋番号", "見本二丁目　７番１の２０３", ""),
            ("建物の名称", "２０３", ""),
            ("①　種　類", "②　構　造", "③　床　面　積　㎡", "原因"),
            ("居宅", "鉄骨造１階建", "２階部分　４１：８０", "平成２年３月４日新築"),
            ("　表　題　部　（敷地権の表示）",),
            ("①土地の符号", "②敷地権の種類", "③敷地権の割合", "原因"),
            ("１・２", "所有権", "１０万分の２５００", "平成２年")),
    block(A_HEAD, TITLE,
          [("１", "所有権保存", "平成２年", "原因　平成２年４月１日売買"), ("", "", "第１号", "所有者　~海区見本一丁目１番１号~"), ("", "", "", "佐　見　本　子")],
          [("付記１号", "１番登記名義人住所変更", "平成９年", "原因　平成９年１月１日住所移転"), ("", "", "第２号", "住所　海区見本三丁目３番３号")])
    + block(B_HEAD, TITLE,
            [("~１~", "~抵当権設定~", "~平成２年~", "~債権額　金９００万円~"), ("", "", "", "~抵当権者　見本銀行株式会社~")],
            ("２", "１番抵当権抹消", "平成８年", "原因　解除"),
            [("３", "抵当権設定", "平成９年", "債権額　金１，５００万円"), ("", "", "", "抵当権者　海区見本　見本信用金庫")]),
)

LAND = (
    block(("　表　題　部　（土地の表示）", "調製"), ("所　在", "海区見本二丁目", ""),
          ("①　地　番", "②地目", "③　地　積　㎡", "原因"),
          ("~７番９~", "宅地", "~３０１：００~", ""),
          ("７番９", "", "２９０：５０", "③錯誤"))
    + block(A_HEAD, TITLE,
            [("１", "所有権保存", "昭和５０年", "所有者　海区見本一丁目１番１号"), ("", "", "", "見本建設株式会社")],
            [("２", "見本建設株式会社持分一部移転", "昭和５１年", "共有者　海区見本二丁目１番１号"), ("", "", "", "持分１万分の２５７"), ("", "", "", "木　見　一　郎"),
             ("", "", "", "海区見本二丁目１番２号"), ("", "", "", "１万分の３００"), ("", "", "", "林　見　花　子")]),
    block(A_HEAD,
          [("３", "木見一郎持分全部移転", "平成１０年", "共有者　海区見本三丁目１番１号"), ("", "", "", "持分１万分の２５７"), ("", "", "", "株式会社見本不動産")],
          [("４", "林見花子持分一部（順位２番で登記した持分）移転", "平成２０年", "共有者　海区見本四丁目１番１号"), ("", "", "", "持分１万分の１００"), ("", "", "", "森　見　次　郎")]),
)
