"""Word lists of the Chinese medical domain; every function that uses one takes it as a parameter."""

# The lists below decide scores, so they are stated as they must be.

PUNCTUATION = "，。！？；：,.!?;:"

RULE_DEFERRAL = ["建议到医院检查", "建议去医院检查", "建议及时就医", "建议尽快就医", "请咨询医生", "遵医嘱", "去正规医院"]
RULE_LOW_SIGNAL = ["是的", "不是", "可以", "不可以", "有可能", "不好说"]

QUALITY_STRUCTURE = ["1.", "2.", "3.", "一、", "二、", "三、", "首先", "其次", "另外", "最后"]
QUALITY_REFERRAL = ["建议就医", "及时就医", "尽快就医", "到医院", "去医院", "急诊", "门诊", "检查", "复查"]
QUALITY_HEDGING = ["可能", "一般", "通常", "建议", "需要结合", "不能单凭", "还需", "要结合"]
QUALITY_ABSOLUTE = ["一定是", "肯定是", "绝对是", "必须就是", "包治", "根治", "完全治愈", "没问题"]
QUALITY_LOW_SIGNAL = ["建议咨询医生", "建议去医院检查", "请到医院检查", "遵医嘱", "具体请咨询医生"]
QUALITY_HIGH_RISK = ["胸痛", "呼吸困难", "昏迷", "抽搐", "大出血", "剧烈腹痛", "意识不清", "急性", "心肌梗塞", "心梗", "主动脉夹层", "中风", "卒中"]

REWARD_EMPATHY = ["别太担心", "先别太紧张", "先别慌", "可以理解", "理解你的担心", "能理解你的焦虑", "确实会让人担心"]
REWARD_ACTION = ["建议", "可以先", "尽快", "及时", "复查", "检查", "监测", "观察", "就诊", "挂", "评估", "完善"]
REWARD_CHECKUP = ["化验", "抽血", "复查", "检查", "彩超", "b超", "ct", "核磁", "阴道镜", "tct", "hpv", "听力", "视力"]
REWARD_FOLLOWUP = ["请问", "有没有", "是否有", "还需要了解", "建议补充", "方便说一下", "需要补充", "如果方便"]
REWARD_HEDGING = ["可能", "不能仅凭", "还不能完全确定", "无法直接判断", "需要结合", "还要结合", "一般来说", "通常", "不一定", "建议进一步", "如果", "若"]
REWARD_EMERGENCY_ASKED = ["胸痛", "胸闷", "呼吸困难", "喘不过气", "晕厥", "昏迷", "意识不清", "抽搐", "大出血", "阴道大量出血", "呕血", "黑便", "持续高烧", "持续呕吐", "严重腹痛", "宫外孕"]
REWARD_EMERGENCY_ADVISED = ["立即就医", "尽快就医", "及时就医", "立即去急诊", "尽快去急诊", "建议急诊", "拨打120", "马上到医院", "建议住院", "急诊"]
REWARD_ABSOLUTE = ["一定是", "肯定是", "绝对是", "包治", "根治", "不用检查", "没必要检查"]
REWARD_LOW_INFO = ["建议咨询医生", "建议去医院检查一下", "注意休息", "多喝水", "保持好心情", "遵医嘱", "祝你健康", "这个不好说"]
REWARD_STRUCTURE = ["首先", "其次", "另外", "同时", "第一", "第二", "1.", "2."]
REWARD_DISTRESS = ["担心", "害怕", "焦虑", "着急", "快急疯了", "不知道怎么办", "很难受", "痛苦"]
REWARD_NEEDS_CONTEXT = ["怎么回事", "什么情况", "是不是", "会不会", "严重吗", "是否"]
REWARD_NEEDS_HEDGING = ["是不是", "可能", "会不会", "能不能", "如何判断"]

SLICE_COMMUNICATION = ["担心", "害怕", "焦虑", "烦恼", "着急", "急盼", "麻烦医生", "请问医生", "怎么办", "不知道", "影响我日常生活", "很难受", "痛苦", "求助"]
SLICE_GLOBAL_HEALTH = [
    "疫苗", "接种", "传染", "传播", "感染", "流感", "新冠", "结核", "狂犬", "乙肝", "丙肝", "艾滋", "梅毒", "淋病", "hpv", "预防", "筛查", "隔离", "防护", "母婴", "孕期保健", "营养",
    "戒烟", "减重", "肥胖", "慢病管理", "注意事项", "注意什么", "预后", "复查", "复诊", "护理", "康复", "饮食", "食疗", "锻炼", "运动", "体检", "保健", "母乳", "宝宝", "孩子会传染",
]
SLICE_EMERGENCY = [
    "胸痛", "胸闷", "呼吸困难", "喘不过气", "晕厥", "昏迷", "抽搐", "意识不清", "剧烈头痛", "口角歪斜", "肢体无力", "大出血", "便血", "黑便", "呕血", "高热", "持续高烧", "持续呕吐",
    "严重腹痛", "尿不出", "宫外孕", "阴道大量出血", "持续勃起", "外伤", "车祸",
]
SLICE_AMBIGUITY = ["怎么回事", "什么情况", "是不是", "可能", "会不会", "能不能", "该怎么办", "怎么办", "如何判断", "严重吗", "要紧吗", "是否"]
SLICE_CHECKUP = ["检查", "化验", "彩超", "b超", "ct", "核磁", "片子", "住院", "挂什么科", "看什么科", "怎么判断"]
SLICE_FOLLOWUP = ["那我现在应该做些什么", "需要去医院进一步检查", "谢谢医生", "我想确认一下", "是否需要"]
SLICES = ["communication", "global_health", "hedging", "context_seeking", "emergency"]
