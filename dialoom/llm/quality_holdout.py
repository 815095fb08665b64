"""Hand-checked texts of each kind, written for calibration; no tree is fitted on them."""

from __future__ import annotations

_PROSE = [
    "The ward was quiet that evening. A nurse sat with the old man and asked how his knee felt after the walk.",
    "Drink a glass of water before bed. If the cough stays for more than two weeks, see your doctor.",
    "今天上午门诊来了不少老人，大多是来复查血压的。医生一边量，一边问他们最近睡得怎么样。",
    "如果晚上经常起夜，先看看睡前是不是喝了太多水。调整一周还不见好，再去医院检查也不迟。",
    "La paciente llegó por la mañana con dolor de cabeza. Le pedimos que descansara y que volviera si empeoraba.",
    "1. Rest the ankle for a few days and keep it raised when you sit.\n2. Put something cold on it twice a day, but never ice on bare skin.\n3. Start walking again as soon as it does not hurt.",
    "1、先不要着急，把最近吃过的药都写下来带给医生看。\n2、饮食上尽量清淡，辣的和油的都先放一放。\n3、要是发热超过三天，就不要再等了。",
    "The study began in spring and lasted for a year. We asked every\nvisitor how far they had walked that day, and most of them could\nnot say. That alone is worth knowing, because the advice we give\nrests on such numbers.",
    "医院的走廊很长，墙上贴着一排宣传画。他每\n次来都要停下来看一会儿，好像能从那些画里\n找到答案。其实他只是不想太早走进诊室。",
    "Patient: I have had a sore back since Monday. Should I rest?\nDoctor: Short walks are better than lying down all day. Come back if your leg feels numb.",
    "患者：最近总是睡不着，怎么办？\n医生：先把下午的咖啡停了，晚上早点放下手机，两周后再看看。",
    "Before the trip we packed only what we needed:\n- warm socks\n- a torch\nThe rest we left at home, and nobody missed it. The weather stayed mild for the whole week, so even the socks were not used.",
    "He slept well.",
    "多喝水，早点休息。",
]
_LIST = [
    "milk\neggs\nflour\nrice\nsoap\nstamps",
    "- left knee\n- right hip\n- lower back\n- neck\n- both wrists",
    "Packing\n1. socks\n2. torch\n3. passport\n4. water bottle\n5. map",
    "血压计\n体温计\n棉签\n创可贴\n口罩\n酒精",
    "需要带的东西：\n* 身份证\n* 病历本\n* 换洗衣服\n* 拖鞋\n* 水杯",
    "1、头晕\n2、恶心\n3、没胃口\n4、睡不好\n5、手脚凉\n6、出汗",
    "compras;\npan;\nleche;\nhuevos;\naceite;\nsal.",
    "[ ] call the clinic\n[x] pay the bill\n[ ] pick up pills\n[ ] water the plants",
    "a) blood count\nb) chest scan\nc) urine test\nd) eye test\ne) blood sugar: 5.1",
    "苹果200克；\n牛奶一盒；\n鸡蛋六个；\n面包；\n盐。",
]
_TABLE = [
    "name,age,ward,days\nLee,41,3,7\nKim,55,2,4\nRoy,38,3,9\nAda,60,1,12",
    "| drug | dose | times |\n| --- | --- | --- |\n| A | 5 | 2 |\n| B | 10 | 1 |\n| C | 20 | 3 |",
    "日期\t项目\t结果\n2020-01-02\t血糖\t5.6\n2020-01-09\t血糖\t6.1\n2020-01-16\t血糖\t5.9",
    "step      loss      score\n100       2.31      0.41\n200       1.98      0.47\n300       1.75      0.52",
    "<table>\n<tr><td>a</td><td>1</td></tr>\n<tr><td>b</td><td>2</td></tr>\n<tr><td>c</td><td>3</td></tr>\n</table>",
    "│ 姓名 │ 科室 │ 天数 │\n│ 王 │ 内科 │ 3 │\n│ 李 │ 外科 │ 5 │\n│ 赵 │ 儿科 │ 2 │",
    "药名,剂量,次数\n甲片,10,2\n乙片,5,1\n丙片,20,3\n丁片,15,2",
]
_JUNK = [
    "qwxz trbvk plmzn hgfdk wrtpl bnvcx zzkrt mwpql xkcdv jhgfr tplkm nbvzx wqrtk pdfgh lkjzx vbnmq",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    "ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha",
    "测试测试测试测试测试测试测试测试测试测试测试测试测试测试测试测试测试测试测试测试",
    "Home | Login | Cart | Share | Home | Login | RSS | Share | Cookie settings | Home | Cart",
    "首页 » 登录 » 注册 » 下一页 » 返回顶部 » 首页 » 登录 » 收藏 » 举报",
    "Zm9vYmFyYmF6cXV4Zm9vYmFyYmF6cXV4Zm9vYmFyYmF6cXV4Zm9vYmFyYmF6cXV4Zm9vYmFyYmF6cXV4Zm9v",
    "00000000: 4f 6b 20 74 68 69 73 20 69 73 20 6e 6f 74 20 69\n00000010: 6e 74 65 72 65 73 74 69 6e 67 20 61 74 20 61 6c",
    "ä½\xa0å¥½ï¼\x8cä¸\x96ç\x95\x8cã\x80\x82ä»\x8aå¤©å¤©æ°\x94å¾\x88å¥½ã\x80\x82ä½\xa0å¥½ï¼\x8cä¸\x96ç\x95\x8cã\x80\x82",
    "==========================================================================",
    "�们□天¿到�，□院·里¿少�。?生．后□说·¿题�大□．�□¿·",
]


def texts() -> tuple[list[str], list[str]]:
    """Texts and their kinds."""
    groups = (("prose", _PROSE), ("list", _LIST), ("table", _TABLE), ("junk", _JUNK))
    return [t for _, g in groups for t in g], [k for k, g in groups for _ in g]
