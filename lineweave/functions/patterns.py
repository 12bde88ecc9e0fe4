"""Patterns of labels, codes and addresses on invoice lines, as the results to match have them."""

from __future__ import annotations

# Fixed values. Each holds for any letter case unless stated.
HEADER_STRONG = r"품\s*명|품\s*목|품\s*목\s*명|규\s*격|수\s*량|단\s*위|단\s*가|공\s*급\s*가\s*액|공\s*급\s*금\s*액|금\s*액|세\s*액|부\s*가\s*세|합\s*계|비\s*고|제\s*조\s*번\s*호|유\s*효\s*기\s*간|보\s*험\s*코\s*드|품\s*목\s*코\s*드"
HEADER_WEAK = r"품\s*명|품\s*목|규\s*격|수\s*량|단\s*가|공급\s*가액|세\s*액|합\s*계|금\s*액|비\s*고|제조\s*번호|유효\s*기간|보험\s*코드"
STANDALONE_LABEL = r"품\s*명|품\s*목|품\s*목\s*명|규\s*격|수\s*량|단\s*위|단\s*가|공\s*급\s*가\s*액|공\s*급\s*금\s*액|금\s*액|세\s*액|부\s*가\s*세|합\s*계|비\s*고|상\s*호|주\s*소|성\s*명|사\s*업\s*자\s*번\s*호|거\s*래\s*일\s*자|주\s*문\s*일\s*자|연\s*락\s*처|창\s*고|영\s*업\s*사\s*원|영\s*업\s*지\s*점"
BUSINESS_CONTACT = r"사\s*업\s*자\s*번\s*호|등\s*록\s*번\s*호|대\s*표\s*자|주\s*소|전\s*화|이\s*메\s*일|업\s*태|종\s*목|공\s*급\s*자|공\s*급\s*받\s*는\s*자|거\s*래\s*처|귀\s*하|사\s*업\s*장|계\s*좌\s*번\s*호|영\s*업\s*지\s*점|영\s*업\s*사\s*원|담\s*당\s*자|상\s*호|법\s*인\s*명|연\s*락\s*처|TEL|FAX|E-?mail|Page|Fa:"
SUMMARY_STRONG = r"합\s*계|소\s*계|총\s*계|총\s*합\s*계|공\s*급\s*가\s*액|공\s*급\s*가\s*력|공\s*급\s*금\s*액|공\s*급\s*대\s*가|세\s*액|부\s*가\s*세|부\s*가\s*가\s*치\s*세|세\s*역|청\s*구\s*금\s*액|결\s*제\s*금\s*액|총\s*결\s*제\s*액|잔\s*액|누\s*계|미\s*수|인\s*수\s*확\s*인|담\s*당\s*자|TOTAL"
SUMMARY = r"공\s*급\s*금\s*액|공\s*급\s*가\s*액|공\s*급\s*액|공\s*급\s*가력|공\s*급\s*대\s*가|세\s*액|새\s*액|세\s*익|세\s*악|부\s*가\s*세|부\s*가\s*서|VAT|합\s*계|함\s*계|합\s*계\s*금\s*액|총\s*결\s*제\s*액|청\s*구\s*금\s*액|결\s*제\s*금\s*액|잔\s*액|누\s*계|인수\s*확인|인수자|창\s*고|Page|Fa:|페이지|TOTAL"
SUMMARY_ONLY = r"TOTAL|[가-힣\s]*(?:합계|총계|VAT|TOTAL)[가-힣\s]*"
TOTAL_ANCHOR = r"합\s*계|총\s*계|총\s*합\s*계|총\s*금\s*액|총\s*액|총\s*결\s*제\s*액|공\s*급\s*대\s*가|청\s*구\s*금\s*액|청\s*구\s*액|결\s*제\s*금\s*액|합\s*계\s*금\s*액|\bTOTAL\b"
HEADER_LABEL = r"거래명세서?|거래명세표|공급자|공급받는자|사업자|등록번호|대표자|주소|소재지|작성|년|월|일|귀하|법인명|상호|성명"
BAD_DATA = r"사업장|주소|성명|대표|세액|합계|FAX|TEL|Page|창고|인수확인"
NOTICE = r"전자장부|웹서비스|계약코드|상품단품|거래명세서|거래명세표|공\s*급\s*받|공\s*급\s*자|사업자|등록번호|대표|성명|주소|업태|종목|전화|연락처|TEL|FAX|인수|확인|서명|Page|PAGE|페이지|담당자|거래처|주문서|영업사원|영업지점|팀\s*지?점\s*코드|지점\s*코드|팀\s*.*코드"
REGION = r"서울|경기|인천|부산|대구|광주|대전|울산|세종|강원|충북|충남|전북|전남|경북|경남|제주"
COMPANY = r"주식회사|주식\s*희사|\(\s*주\s*\)?|주\)|유\)|약\s*품|임플란트|회사|지점|예일선"
COMPANY_WORD = r"\(\s*주\s*\)|주\s*\)|주식|회사"
ITEM_HINT = r"정|캡슐|캡슬|크림|액|mg|ml|g|T|C"
DOSAGE = r"TABLET|ABLET|CAPSULE|CAPS?|TAB|CAP"
CODE_DOSAGE = r"TABLET|ABLET|CAPSULE|CAPS?|TAB|CAP|캡슐|캡슬|mg|ml"
ITEM_UNIT = r"mg|ml|g|T|C|BOX|CAP|TAB|정|캡|액|크림"
PRODUCT = r"(?:정|액|크림|시럽|겔)$|캡슐|캡슬|TABLET|ABLET|CAPSULE|CAPS?|\d+(?:[.,]\d+)?\s*(?:mg|ml|g|kg|t|c|p|tab|cap|dose)"
NAME_TAIL = r"[가-힣A-Za-z0-9]{2,}(?:정|액|캡슐|캡슬|산|크림|겔|시럽|플란정)$"
SPEC_ONLY = r"\d+(?:[.,]\d+)?(?:mg|ml|g|kg|t|tab|cap|caps?|c|정|캡슐|포|병|box|ea|p|dose|mI)(?:\([^)]+\))?"
FINAL_REJECT = r"^(?:전?일?잔액|잔액|주문서|주문NO|단가|단뭐|수량|공급|세액|합계|거래일자|주문일자|품목코드|계약코드|거래명세|담가|누계|.*(?:거래금액|잔액|잔고|금액)$)"
STREET_NUMBER = r"[가-힣]{1,12}(?:로|길)\s*\d"
STREET_TAIL = r"(?:로|길)\d+|\d+\([가-힣]+동\)|[가-힣]+동\)"
#: Labels of parties on invoices.
REPRESENTATIVE_ANCHOR = r"성\s*명|대표자(?:명)?"
#: Labels of summary amounts on invoices (letters of any case but in the first two), and words of rows that hold none.
SUPPLY_LABEL = r"공\s*급\s*가\s*액|공\s*급\s*액|공\s*급\s*금\s*액|공\s*급\s*가(?![가-힣])|과\s*세\s*금\s*액|매\s*출\s*액|순\s*매\s*출"
WEAK_SUPPLY_LABEL = r"소\s*계|과\s*세"
TAX_LABEL = r"세\s*액|새\s*액|세\s*익|세\s*악|부\s*가\s*세|부\s*가\s*서|부\s*가\s*가\s*치\s*세|\bVAT\b|\bV\.A\.T\b|\bTAX\b"
TOTAL_LABEL = r"합\s*계|총\s*계|총\s*합\s*계|총\s*금\s*액|총\s*액|청\s*구\s*금\s*액|청\s*구\s*액|결\s*제\s*금\s*액|총\s*공\s*급\s*대\s*가|공\s*급\s*대\s*가|합\s*계\s*금\s*액|\bTOTAL\b"
ITEM_CONTEXT = r"품\s*명|품\s*목|품\s*코드|수\s*량|단\s*가"
NO_SUMMARY = r"사업자|등록번호|전\s*화|FAX|TEL|계좌|은행|Page|페이지"
INVOICE_DATE = r"(?<!\d)\d{4}\s*년\s*\d{1,2}\s*월\s*\d{1,2}\s*일|(?<!\d)(?:\d{4}|\d{2})[.\-/]\s*\d{1,2}[.\-/]\s*\d{1,2}(?!\d)"
LOT_CONTEXT = r"Lot\s*No|LOT|Serial|시리얼|로트|유효일자|제품코드|상품코드|품목코드|총수량|수량|단위"
#: Words of receipts that are no names, and labels after which a value ends.
TOP_TEXT = r"다른경우|실제와|가맹점주소가|전기작업|작업지시|직원|식지|재발행|체크카드|신용매출|귀하|안내문|설명문구|예시문구|작성문구|신고안내|여신금융|협회|고객센터|승인번호|카드번호|거래일시|매출전표|공급가액|부가세|합계|총계|품목|수량|단가|금액|van|tid|cat|ibk|nh"
NEXT_LABEL = r"\s*(?:사업자(?:등록)?번호|등록번호|대표자?|성명|주소|TEL|전화|가맹점명|가맹점No|가맹점번호|승인번호|카드번호|거래일시)\s*[:;]?"
PHONE_ADMIN = r"여신금융|협회|신고안내|포상금|고객센터|카드번호|승인번호|거래일시|전표|가맹No|가맹점No|가맹점번호|TID|CAT|VANKEY"
LABEL_ONLY = r"사업자|사업자번호|등록|등록번호|공급자|가맹점명|가맹점번호|가맹점no|가맹점|상호|회사명|업체명|대표자|성명|주소|전화|tel|작성년월일"
REPRESENTATIVE_NOISE = r"테이블|단말|번호|영수증|번길|주문|품목|수량|단가|금액|주소|사업자|가맹점|상호|회사명|cashier|server|guests|station|order|table|menu|item|qty|price|amount"
REPRESENTATIVE_COMPANY = r"(?:주식회사|\(주\)|상사|철물|조명|전기|공구|볼트|약국|카페|마트|편의점|스토어|매장|툴|IBK|NH|KB|비씨|신한|국민|하나|우리|기업은행|cashnote|paykey|vankey)"
SURNAMES = "김이박최정강조윤장임한오서신권황안송전홍유고문양손배조백허남심노하곽성차주우구민류진나엄채원천방공현함변염여추도소석선설마길연위표명기반왕금옥육인맹제모장모국어은편용"
#: Addresses on receipts and invoices.
ADDRESS_START = r"서울|서울시|경기|경기도|인천|인천시|부산|부산시|대구|대구시|광주|광주시|대전|대전시|울산|울산시|세종|세종시|강원|강원도|충북|충청북도|충남|충청남도|전북|전라북도|전남|전라남도|경북|경상북도|경남|경상남도|제주|제주도"
ADDRESS_LABEL = r"(?:사업장\s*)?(?:주소|소재지)|공급자\s*주소|업체\s*주소|본점\s*소재지|사업장\s*소재지"
ADDRESS_CUT = r"\s*(?:TEL|전화|FAX|사업자(?:등록)?번호|등록번호|대표자?|성명|상호|회사명|업체명|가맹점명|가맹No|가맹점No|가맹점번호|승인번호|카드번호|카드사|은행|매입사|거래일시|품목|상품명|수량|단가|금액|합계|총계|부가세|공급가액|판매금액|봉사료|결제|전표|테이블명|판매시간|판매사원|영수번호|작성년월일|공급대가|도매|소매|업태|업종|안내|고객센터)\s*[:;]?"
ADDRESS_TOKENS = r"시|도|군|구|읍|면|동|리|가|로|길|번길|층|호|번지"
ADDRESS_NOISE = r"대표자|성명|상호|회사명|업체명|사업자|등록번호|TEL|전화|FAX|카드|은행|승인|전표|품목|상품명|수량|단가|금액|합계|안내|고객센터"
ADDRESS_BROAD = r"(?:서울|경기|경기도|인천|부산|대구|광주|대전|울산|세종|강원|충북|충남|전북|전남|경북|경남|제주)\s+[가-힣]+시\s+[가-힣]+구"
CITY_PREFIX = r"서울특별시|서울특발시|서울|경기도|인천광역시|인천|부산광역시|부산|대구광역시|대구|광주광역시|광주|대전광역시|대전|울산광역시|울산|세종특별자치시|세종|강원도|강원|충청북도|충북|충청남도|충남|전라북도|전북|전라남도|전남|경상북도|경북|경상남도|경남|제주특별자치도|제주"
MISREAD_SEOUL = ("서울특법시", "서울특발시", "서울록별시", "서울특벌시")
#: Words of addresses on invoices, and of lines that go on with none.
ADDRESS_WORD = REGION + r"|[가-힣]{1,10}(?:시|군|구|동|읍|면|리)|[가-힣]{1,16}(?:로|길|번길)"
NO_ADDRESS_TAIL = r"인수|확인|서명|주문|담당자|영업|팀지점"
#: Names of one field.
FIELD_ALIASES = {
    "회사명": ("회사명", "상호", "상호명", "가맹점명", "companyname", "merchantname", "storename", "vendorname", "suppliername"),
    "사업자번호": ("사업자번호", "사업자등록번호", "등록번호", "bizno", "businessnumber", "businessregistrationnumber"),
    "대표자": ("대표자", "대표자명", "representative", "representativename", "ownername", "ceoname"),
    "tel": ("tel", "telephone", "phone", "phonenumber", "전화", "전화번호"),
    "주소": ("주소", "address", "storeaddress", "companyaddress", "businessaddress"),
    "총합계금액": ("총합계금액", "합계금액", "총액", "totalamount", "amount"),
    "판매금액": ("판매금액", "saleamount"),
    "부가세": ("부가세", "taxamount"),
    "공급가액": ("공급가액", "supplyamount"),
    "승인번호": ("승인번호", "approvalnumber"),
    "카드번호": ("카드번호", "cardnumber"),
    "거래일시": ("거래일시", "transactiondate", "transactiondatetime"),
    "전표번호": ("전표번호", "slipnumber"),
    "가맹번호": ("가맹번호", "merchantnumber"),
}
INTERNAL_KEYS = ("_rawText", "rawText", "_source", "source", "manufacturingExpiryComposite", "serialLotComposite", "rowIndex", "lineIndex", "_confidence", "confidence", "bbox", "extractionSource")
