"""Fixture texts and expected results (FIXTURES.md)."""

# PUBLISHED VALUES: inputs and results that must match, in their published order.

SAMPLE = (
    "고객 정보\n\n고객명: 김철수\n전화번호: 010-1234-5678\n이메일: kim@company.com\n주소: 서울시 강남구 테헤란로 123\n"
    "생년월일: 1980년 5월 15일\n\n상담 내용:\n고객께서 계좌번호 123-45-678901에서 다른 계좌로 이체 문제로 문의하셨습니다.\n"
    "카드번호 4532148803436467 관련하여 결제 승인이 안된다고 하시네요.\n\n연락처 확인: 010-1234-5678\n이메일 확인: kim@company.com"
)

U5 = """
    제 개인정보입니다:
    전화번호: 010-1234-5678
    이메일: test@example.com
    카드번호: 4532 1488 0343 6467
    계좌번호: 123-45-678901
    """

T1 = "문의는 010-9999-8888 또는 help@bank.com 입니다. 카드 4111 1111 1111 1111"

# id -> (text, score, blocked, masked or None, [(type, start, end)])
CASES = {
    "T6": (T1, 37, False, "문의는 010-9999-8888 또는 <EMAIL> 입니다. 카드<CARD>", [("EMAIL", 21, 34), ("CARD", 42, 62)]),
    "T2": ("홍길동의 계좌번호 123-456-7890123 로 이체", 23, False, "홍길동의 계좌번호 <ACCOUNT> 로 이체", [("ACCOUNT", 10, 25)]),
    "T3": ("고객정보: 010-1234-5678, test@example.com, 계좌 111-22-333444", 47, False,
           "고객정보: <PHONE>, <EMAIL>, 계좌 <ACCOUNT>", [("PHONE", 6, 19), ("EMAIL", 21, 37), ("ACCOUNT", 42, 55)]),
    "T4": ("영업시간은 평일 9시부터 16시입니다.", 0, False, "영업시간은 평일 9시부터 16시입니다.", []),
    "T5": ("871301-1234567", 0, False, "871301-1234567", []),
    "U1": ("안녕하세요. 제 연락처는 010-9999-8888이고 이메일은 help@bank.com입니다.", 15, False,
           "안녕하세요. 제 연락처는 010-9999-8888이고 이메일은 <EMAIL>입니다.", [("EMAIL", 35, 48)]),
    "U2": ("제 카드번호는 4532148803436467입니다.", 0, False, "제 카드번호는 4532148803436467입니다.", []),
    "U3": ("제 주민등록번호는 901201-1234567입니다.", 0, False, "제 주민등록번호는 901201-1234567입니다.", []),
    "U4": ("문의사항은 1599-1111로 연락주세요.", 0, False, "문의사항은 1599-1111로 연락주세요.", []),
    "U5": (U5, 47, False, None, [("PHONE", 26, 39), ("EMAIL", 49, 65), ("ACCOUNT", 106, 119)]),
    "R1": ("안녕하세요. 제 전화번호는 010-1234-5678이고 이메일은 user@example.com입니다.", 31, False,
           "안녕하세요. 제 전화번호는 <PHONE>이고 이메일은 <EMAIL>입니다.", [("PHONE", 15, 28), ("EMAIL", 36, 52)]),
    "R2": ("고객 연락처: 010-9876-5432, 계좌: 123-45-678901", 37, False, "고객 연락처: <PHONE>, 계좌: <ACCOUNT>",
           [("PHONE", 8, 21), ("ACCOUNT", 27, 40)]),
    "A1": ("고객 박영희님의 연락처는 010-9876-5432이며, 서울시 강남구 역삼동에 거주합니다.", 33, False,
           "고객 박영희님의 연락처는 <PHONE>이며, <ADDRESS>에 거주합니다.", [("PHONE", 14, 27), ("ADDRESS", 31, 42)]),
    "X1": ("서울시 010-1234-5678 종로", 18, False, "서울시 <PHONE> 종로", [("PHONE", 4, 17)]),
    "X2": ("계좌번호 010-1234-5678", 18, False, "계좌번호 <PHONE>", [("PHONE", 5, 18)]),
    "X3": ("사번: AB123456 우편 06234 ", 28, False, "<ID_NUMBER> 우편 <ADDRESS> ", [("ID_NUMBER", 0, 12), ("ADDRESS", 16, 21)]),
    "X4": ("주민 900101-1234568 ", 28, False, "주민 <RRN> ", [("RRN", 3, 17)]),
}
