"""Parameter tables of the retrieval engine. Every operator takes its rules as arguments; these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass

# Thresholds and weights that decide results.
MIN_TOKENS, MAX_TOKENS = 50, 512
CONFIDENCE = 0.7
STALE_DAYS = 180
HOP_SCORE = {0: 1.0, 1: 0.5, 2: 0.25, 3: 0.125}
FORCED_EDGES = ["BLOCKS", "ENABLES_SHORTCUT"]
PREDICATES = ["CAN_TRANSITION_TO", "REQUIRES", "BLOCKS", "NEXT_STEP", "ISSUED_BY", "RELATED_TO", "ENABLES_SHORTCUT"]
NODE_LABELS = ["Domain", "Topic", "Entity", "Procedure", "Document", "Institution", "Chunk"]
#: The property that an edge of each predicate carries besides the common ones.
EDGE_PROPERTY = {
    "CAN_TRANSITION_TO": "condition", "REQUIRES": "mandatory", "BLOCKS": "block_reason",
    "NEXT_STEP": "step_order", "ENABLES_SHORTCUT": "skip_to", "RELATED_TO": "relation_desc",
}

# Patterns.
HEADER = r"(?m)^(?:유형\s*\d+|(?:\d+\s*단계)|(?:Part\s*\d+)|(?:Q\s*&\s*A)|(?:제\s*\d+\s*[조장절])|(?:■|●|◆|\d+\.))\s*.{0,40}$"
SECTIONS = [r"(?i)유형\s*\d+", r"\d+\s*단계", r"(?i)Part\s*\d+", r"(?i)Q\s*&\s*A", r"제\s*\d+\s*[조장절]"]
SENTENCE_END = r"(?<=[.!?。])\s+"
CODE = r"\b([A-Z]-\d+(?:-\d+)?)\b"
IMPOSSIBLE = r"연장\s*불가"
HAN, HANGUL = r"[一-鿿]", r"[가-힣]"
FOREIGN_SCRIPT = r"[一-鿿぀-ヿ฀-๿]"
NOT_PLAIN = r"[^\w\s가-힣ㄱ-ㅎㅏ-ㅣ\-·,.()%/&@#:\[\]\{\}\"\'?!~]"

# Word lists.
ALIASES = {
    "D2": "D-2", "D4": "D-4", "F5": "F-5", "영주권": "F-5", "어학원비자": "D-4", "일반연수비자": "D-4",
    "유학비자": "D-2", "어학연수비자": "D-4", "학생비자": "D-2",
}
INSTITUTIONS = ["출입국관리사무소", "국민건강보험공단", "하이코리아", "외국인종합안내센터", "동아대학교", "국제교류처", "법무부", "고용노동부"]
INTENTS = {
    "visa": ["비자", "체류", "d-2", "d-4", "f-2", "f-5", "e-7", "연장", "전환", "체류자격", "비자연장", "체류기간", "사증", "전자사증", "입국", "입국심사", "출국"],
    "arc": ["외국인등록", "외국인등록증", "arc", "등록증", "외국인 등록", "외국인등록번호", "등록번호"],
    "health_insurance": ["건강보험", "의료보험", "보험 가입", "보험료", "건강보험료", "nhis"],
    "academic": ["학사일정", "수강신청", "등록금", "휴학", "복학", "학기", "졸업", "성적", "시험", "중간시험", "기말시험", "출결", "전자출결", "강의", "수업", "장학금", "학점"],
    "dormitory": ["기숙사", "생활관", "한림생활관", "기숙", "호실", "편의시설", "입사", "기숙사비", "룸"],
    "life_admin": ["출입국", "주소변경", "주소 변경", "취업허가", "시간제취업", "시간제 취업", "시간제", "은행 계좌", "장학금", "아르바이트", "픽업", "신입생 픽업", "캠퍼스", "특성화"],
}
ANCHORS = {
    "visa": ["비자 연장", "체류기간 연장", "D-2", "D-4", "비자 전환", "체류자격 변경", "사증", "입국심사"],
    "arc": ["외국인등록증", "ARC", "외국인등록", "외국인 등록증", "외국인등록번호"],
    "health_insurance": ["건강보험", "건강보험 가입", "건강보험 납부", "의료보험"],
    "academic": ["학사일정", "수강신청", "등록금", "휴학", "복학", "중간시험", "기말시험", "전자출결", "학점"],
    "dormitory": ["기숙사", "생활관", "한림생활관", "기숙사비", "호실"],
    "life_admin": ["출입국관리사무소", "주소 변경", "취업 허가", "시간제 취업", "픽업 서비스", "캠퍼스"],
}
#: In order; the first that has a term in the question names its type.
QUESTION_TYPES = {
    "comparison": ["비교", "차이", "둘 중", "versus", "difference", "compare", "区别", "比较"],
    "cause": ["왜", "원인", "이유", "cause", "reason", "why", "原因", "为什么"],
    "exception": ["예외", "제외", "except", "unless", "exception", "例外", "除外"],
    "deadline": ["기한", "마감", "언제까지", "deadline", "due", "截至", "期限"],
    "documents": ["서류", "준비물", "필요", "documents", "required", "材料", "文件"],
    "application": ["신청", "절차", "어떻게", "apply", "process", "流程", "办理"],
}
COMPLEX_TYPES = ["comparison", "cause", "exception"]
VARIANTS = {
    "ko": ["비교 차이", "원인 이유", "예외 제외"],
    "zh": ["比较 区别", "原因 为什么", "例外 除外"],
    "en": ["comparison difference", "cause reason", "exception unless"],
}
#: A question with one of these is too complex for a stock answer.
COMPLEX_TERMS = [
    "하기 전에", "이전에", "이후에", "하려면", "할 때", "경우에", "필요한가요", "필요합니까", "필요한지", "동시에",
    "먼저", "그리고", "뿐만 아니라", "관련이 있", "어떤 영향", "납부", "확인이", "과 함께", "와 함께", "둘 다",
    "모두 필요", "비교", "차이", "어떻게 달라", "연관", "조건", "조건부", "복합", "또는",
]
HOST_SUFFIXES = "go.kr,ac.kr,gov,edu,gov.cn,edu.cn,ac.uk,gov.uk"
IMAGE_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "gif": "image/gif"}

# Messages by language; `en` stands in for others.
NO_EVIDENCE = {
    "ko": "현재 근거가 충분하지 않아 단정적으로 답변하기 어렵습니다. 핵심 조건(비자 유형, 학교, 마감일)을 알려주시면 정확도를 높일 수 있습니다.",
    "zh": "目前证据不足，无法给出确定答案。请补充签证类型、学校和截止日期等关键信息。",
    "en": "Evidence is currently insufficient for a confident answer. Please share key constraints such as visa type, school, and deadline.",
}
REFUSAL = "제공된 자료에서는 확인할 수 없습니다. 동아대 국제교류처(연락처) 또는 하이코리아(hikorea.go.kr)에 직접 문의 바랍니다."
PROFILE_UPDATED = {
    "ko": "확인했습니다. 현재 사용자 정보는 아래와 같습니다.\n%s\n이 정보를 기준으로 다음 질문에 더 정확히 답변하겠습니다.",
    "zh": "已确认，当前用户信息如下：\n%s\n接下来我会基于这些信息提供更准确的回答。",
    "en": "Confirmed. Current user profile:\n%s\nI will use this profile for more accurate follow-up answers.",
}
DISCLAIMER = "\n\n⚠️  이 정보는 [%s] (%s) 기준입니다. 최신 정보는 하이코리아(hikorea.go.kr) 또는 외국인종합안내센터(1345)에서 확인하세요."
TRIPLES_TITLE, TEXTS_TITLE, SOURCES_TITLE, SECTION_TITLE = "[그래프 트리플]", "[원문]", "[출처] ", "섹션: "
WEB_TITLE = "[외부 검색 결과]"
BLOCKED_SUBJECT, BLOCKED_SUFFIX, BLOCKED_REASON = "건강보험미납", "_연장", "건강보험 미납 시 비자 연장 불가"

# Parts of the prompt by language; `en` stands in for others.
ROLES = {
    "ko": "당신은 유학생 안내 도우미입니다. 질문 언어와 동일한 언어로 답하세요. 근거 문서 기반으로만 답변하고, 근거가 약하면 불확실성을 명시하세요.",
    "zh": "你是留学生事务助手。请使用与用户输入相同的语言回答。仅基于证据内容作答，证据不足时明确说明不确定性。",
    "en": "You are an assistant for international students. Respond in the same language as the user. Answer only from evidence and state uncertainty when evidence is weak.",
}
STYLES = {
    "ko": "출력 형식:\n1) 핵심 답변\n2) 지금 해야 할 일(번호 목록)\n3) 준비 서류/확인 항목\n4) 기한/주의사항\n5) 근거 요약(출처 기반 요약만)",
    "zh": "输出格式：\n1) 核心回答\n2) 现在要做的事（编号列表）\n3) 材料/确认事项\n4) 时限/注意事项\n5) 证据摘要（仅来源摘要）",
    "en": "Output format:\n1) Core answer\n2) Actions to take now (numbered)\n3) Required documents/checklist\n4) Deadline/cautions\n5) Evidence summary (source-grounded only)",
}
TYPE_HINTS = {
    "comparison": {"ko": "질문 유형: 비교형. 항목별 차이를 표기하세요.", "zh": "问题类型：比较型。请按项目对比差异。", "en": "Question type: comparison. Contrast key differences by item."},
    "cause": {"ko": "질문 유형: 원인형. 원인과 대응책을 분리해 적으세요.", "zh": "问题类型：原因型。请区分原因与应对措施。", "en": "Question type: cause. Separate causes from actions."},
    "exception": {"ko": "질문 유형: 예외형. 일반 규칙과 예외 조건을 구분하세요.", "zh": "问题类型：例外型。区分一般规则与例外条件。", "en": "Question type: exception. Distinguish default rule and exceptions."},
}
CAUTION = "Do not reveal chain-of-thought. Show only concise evidence summary.\nIf evidence is weak, say uncertainty clearly and ask a focused follow-up question."
PROFILE_TITLE, HISTORY_TITLE, CONTEXT_TITLE, EVIDENCE_TITLE, QUESTION_TITLE = "User Profile", "Recent Conversation", "Evidence Context", "Evidence Sources", "User Question"
#: Columns of the node tables besides entities and chunks.
NODE_COLUMNS = {
    "Domain": ["id", "name"], "Topic": ["id", "name", "domain"], "Document": ["id", "name", "domain"], "Institution": ["id", "name", "domain"],
    "Procedure": ["id", "name", "step_order", "parent_proc", "description", "duration_est", "domain"],
}


@dataclass(frozen=True)
class Ranking:
    """Weights and limits of search and re-ranking."""

    cosine: float = 0.65
    keyword: float = 0.25
    recency: float = 0.10
    merge_base: float = 0.60
    merge_keyword: float = 0.30
    merge_recency: float = 0.10
    graph_base: float = 0.75
    fetch: int = 10
    widen: int = 3
    top: int = 4
    least_score: float = 0.30
    least_fit: float = 0.06
    gate_score: float = 0.25
    gate_evidence: int = 2
    link_cosine: float = 0.72
    link_top: int = 3
    hops: int = 2
    edges: int = 8
    neighbours: int = 300
    graph_chunks: int = 2


RANKING = Ranking()

#: What a model is asked for when chunks or pictures are read by it; every function that uses them takes others.
EXTRACTION_ASK = "Read the text and list the entities and relations it states, as one JSON object and nothing else."
PICTURE_ASK = "Read the flow chart and list its boxes as entities and its arrows as relations, as one JSON object and nothing else."
REPLY_FORM = (
    '{"entities": [{"id", "name", "type", "domain", "aliases", "summary", "confidence"}], '
    '"relations": [{"subject_id", "predicate", "object_id", "condition", "confidence", "source_text"}]}'
)
