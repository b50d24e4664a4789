"""Column functions over report titles and enterprise names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords of report titles, the pattern's variant of them, report cycles in order, name parts of enterprises.
REPORT_KEYWORDS = ("环评", "环境评估", "环境影响", "环境报告", "竣工环保", "验收监测", "排污许可", "应急预案", "清洁生产", "环保验收", "EIA", "环境影响评价", "建设项目环境影响", "报告书", "报告表", "登记表")
REPORT_PATTERN = "(?i)环评|环境影响|环境评估|竣工环保|验收监测|排污许可|应急预案|清洁生产|环保验收|报告书|报告表|EIA"
REPORT_CYCLES = {
    "annual_report": "年[度报]|年度报告|年报",
    "half_year_report": "半年[度报]|半年度报告|中报|中期报告",
    "quarterly_report": "第[一二三]季度|一季报|三季报|季报",
    "esg_report": "(?i)ESG|环境.*社会.*治理|社会责任|可持续发展|绿色|低碳|环境报告|企业环境",
    "prospectus": "招股|募集|上市公告",
}
COMPANY_WORDS = ("公司", "集团", "厂", "企业", "有限", "股份")
COMPANY_SUFFIXES = "有限公司|有限责任公司|股份有限公司|集团公司|集团|公司|厂|研究院|研究所"


def contains_any(text: Column, words) -> Column:
    found = F.lit(False)
    for w in words:
        found |= text.contains(w)
    return found


def is_env_report(title: Column, keywords=REPORT_KEYWORDS) -> Column:
    return contains_any(title, keywords)


def matches_report(text: Column) -> Column:
    return text.rlike(REPORT_PATTERN)


def classify_report_cycle(title: Column, half_year_first: bool = False) -> Column:
    """The first cycle whose pattern is in the title, else 'other'. Half-year titles read as annual unless half_year_first."""
    names = list(REPORT_CYCLES)
    if half_year_first:
        names[0], names[1] = names[1], names[0]
    chosen = F.when(title.rlike(REPORT_CYCLES[names[0]]), names[0])
    for n in names[1:]:
        chosen = chosen.when(title.rlike(REPORT_CYCLES[n]), n)
    return chosen.otherwise("other")


def is_enterprise_name(text: Column) -> Column:
    return F.length(text).between(4, 60) & text.rlike(r"[一-鿿]") & contains_any(text, COMPANY_WORDS)


def extract_enterprise(title: Column) -> Column:
    """The first run of Chinese characters and brackets that ends in a company suffix, else ''."""
    return F.regexp_extract(title, rf"([一-鿿（）()]{{2,60}}(?:{COMPANY_SUFFIXES}))", 1)
