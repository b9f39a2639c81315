"""Domain vocabulary, as plain values and as literal columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, which results must equal.

UNREVIEWED, AI_REVIEWED, CONFIRMED, NEEDS_REVIEW = "未审", "AI已审", "人工已确认", "待复核"
REVIEW_STATUSES = [UNREVIEWED, AI_REVIEWED, CONFIRMED, NEEDS_REVIEW]

UNKNOWN_TYPE, DEFAULT_SUBTYPE = "无法判断", "未细分"
PHOTO_TYPES = ["婚纱照", "个人写真", "证件照", "全家福", "情侣照", "儿童照", "孕妇照", "商业形象照", "会议/活动照", "产品/静物", "风景/环境", "素材/练习", UNKNOWN_TYPE]
SUBTYPES = {
    "婚纱照": ["主纱", "秀禾/中式", "外景婚纱", "棚内婚纱", "单人新娘", "单人新郎", "双人互动", "仪式感大片", "标准客片", "情绪片"],
    "个人写真": ["生日写真", "情绪写真", "棚拍写真", "外景写真", "职业形象", "氛围感人像", "半身", "全身", "特写"],
    "证件照": ["白底", "蓝底", "红底", "一寸", "二寸", "简历照", "考试报名照", "职业证件照"],
    "全家福": ["三口之家", "多人家庭", "长辈合影", "儿童家庭", "正式合影", "生活感合影"],
    "会议/活动照": ["会议合影", "领导讲话", "现场纪实", "签约仪式", "团队合影", "花絮"],
    "风景/环境": ["建筑", "城市", "自然风光", "旅行记录", "空镜素材", "环境交代"],
}

RATINGS = {"S": "强烈推荐", "A": "可交付", "B": "备选", "C": "留档/练习", "X": "废片"}
RATING_BOUNDS = [("S", 90), ("A", 75), ("B", 60), ("C", 40)]

NO_EXPORT = "不导出"
DELIVERY_USES = ["精修候选", "客户可选", "直接交付", "作品集候选", "小红书/朋友圈展示", "修图练习", "内部参考", "仅留档", NO_EXPORT]
USE_FOLDERS = {
    "客户可选": "01_客户可选", "精修候选": "02_精修候选", "作品集候选": "03_作品集候选", "直接交付": "04_直接交付", "小红书/朋友圈展示": "05_小红书朋友圈展示",
    "修图练习": "06_修图练习", "内部参考": "07_内部参考", "仅留档": "08_仅留档", "不导出": "09_不导出清单",
}
TYPE_FOLDER = "10_按类型整理"

REPAIRABLE = "技术可修"
ISSUE_TAGS = ["虚焦", "闭眼", "表情弱", "表情崩", "体态问题", "服装穿帮", "背景杂乱", "构图普通", "曝光问题", "色彩问题", "重复照片", "裁切风险", "客户可能不喜欢", REPAIRABLE, "气质不对", "作品感不足"]

MANUAL_CATEGORIES = ["精修候选", "可交付", "备选", "重复", "废片", "作品集候选", "练习片", "人工复核"]
DEFAULT_MANUAL = "备选"
LEGACY_MANUAL = {"精选": "精修候选", "待定": "备选", "可用待修": "可交付", "可用待裁切": "重复"}

PRIMARY_REVIEW, PRIMARY_DUPLICATE, PRIMARY_REJECT = "人工复核", "相似重复待选", "废片疑似"
PRIMARY_CATEGORIES = ["单人写真", "双人写真", "多人写真", "婚纱照", "全家福", "亲子照", "儿童写真", "中老年写真", "商务会议合影", "活动纪实", "证件/形象照", "风景/环境", PRIMARY_DUPLICATE, PRIMARY_REJECT, PRIMARY_REVIEW]

GROUP_STATUSES = ["best", "backup", "duplicate", "rejected", "review"]
GROUP_PENALTY_TAGS = ["虚焦", "闭眼", "表情崩", "曝光问题"]
GROUP_RATING_BONUS = {"S": 18, "A": 14, "B": 8, "C": 2, "X": -12}
GROUP_RATING_DEFAULT = 6
HAMMING_BY_MODE = {"strict": 5, "standard": 8, "loose": 12}

PRESETS = {
    "个人写真": {"表情情绪": 25, "姿态自然": 20, "光线氛围": 20, "构图": 15, "清晰度": 15, "背景干净度": 5},
    "婚纱照": {"表情互动": 25, "体态服装": 25, "光线氛围": 20, "构图完整": 15, "清晰度": 15},
    "证件照": {"清晰度": 30, "脸部正面": 25, "背景规范": 20, "曝光肤色": 15, "服装肩线": 10},
    "全家福": {"所有人表情": 35, "清晰度": 20, "站位完整": 20, "亲密关系感": 15, "背景整洁": 10},
    "会议/活动照": {"信息完整": 30, "关键人物清晰": 25, "构图稳定": 15, "曝光正常": 15, "记录价值": 15},
    "作品集标准": {"个人风格": 25, "叙事感": 20, "独特性": 20, "光影": 20, "空间感": 15},
    "默认通用标准": {"清晰度": 25, "曝光": 20, "构图": 20, "主体状态": 20, "后期潜力": 15},
}
DEFAULT_PRESET = "默认通用标准"

# visual quality, semantic, relative, preference
PICK_WEIGHTS = {
    "delivery": (0.35, 0.25, 0.25, 0.15), "learned": (0.25, 0.20, 0.20, 0.35), "portfolio": (0.30, 0.30, 0.25, 0.15),
    "conservative": (0.30, 0.25, 0.20, 0.25), "strict": (0.40, 0.25, 0.25, 0.10),
}

SUGGESTION_VERSION = "business_classifier_v2"
PREFERENCE_VERSION = "local-preference-v1"
AESTHETIC_TAGS = ["我喜欢", "我不喜欢", "构图好", "光线好", "表情好", "色彩好", "氛围好", "商业可交付", "作品集级别", "废片", "可修图"]

PHOTO_EXTENSIONS = ["jpg", "jpeg", "png", "webp"]
RAW_EXTENSIONS = ["raw", "arw", "cr2", "cr3", "nef", "dng", "raf", "orf", "rw2"]

# End of fixed values.


def array_of(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def lookup(values: dict, key: Column, default: object = None) -> Column:
    """values[key] by a literal map, or default."""
    table = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    found = F.try_element_at(table, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def rows_of(spark, values: list[tuple], names: list[str]):
    """A small dimension frame."""
    return spark.createDataFrame(values, names)
