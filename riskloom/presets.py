"""The health-survey setting: column names, texts and code lists.

Operators take all of this as arguments; nothing else in the package knows it.
"""

from __future__ import annotations

from .operators.features import Derived
from .operators.report import ReportConfig
from .operators.rules import Constraint, Rule

LABEL = "Diabetes_binary"

# Derived columns. Products and the sum fall back to 0 where a
# source column is absent, squares are left out.
DERIVED = [
    Derived("BMI_Age", "product", ("BMI", "Age")),
    Derived("HighBP_Chol", "product", ("HighBP", "HighChol")),
    Derived("MentPhysHlth", "sum", ("MentHlth", "PhysHlth")),
    Derived("BMI_squared", "square", ("BMI",), "omit"),
    Derived("Age_squared", "square", ("Age",), "omit"),
]

# Result texts by prediction.
RESULT_TEXT = {
    1: "Có nguy cơ mắc bệnh tiểu đường",
    0: "Không có nguy cơ mắc bệnh tiểu đường",
}

# Advice in display order, and the text used where none applies.
ADVICE = [
    Rule("prediction", "=", 1, "Ban co nguy co mac benh tieu duong. Nen tham khao y kien bac si."),
    Rule("BMI", ">", 25, "BMI cua ban cao. Nen giam can va tap the duc thuong xuyen."),
    Rule("HighBP", "=", 1, "Ban co huyet ap cao. Nen kiem soat huyet ap va theo doi dinh ky."),
    Rule("HighChol", "=", 1, "Ban co cholesterol cao. Nen dieu chinh che do an uong."),
    Rule("PhysActivity", "=", 0, "Nen tang cuong hoat dong the chat it nhat 30 phut moi ngay."),
    Rule("Fruits", "=", 0, "Nen an nhieu trai cay va rau qua trong che do an uong."),
    Rule("Smoker", "=", 1, "Hut thuoc lam tang nguy co mac benh. Nen bo thuoc la."),
]
ADVICE_FALLBACK = "Ban dang co loi song lanh manh. Hay tiep tuc duy tri!"

# Columns of the descriptive report.
REPORT = ReportConfig(
    label=LABEL,
    numeric=["BMI", "MentHlth", "PhysHlth", "Age"],
    categorical=["HighBP", "HighChol", "Smoker", "PhysActivity", "Fruits", "Sex"],
)

# The form's fields and their domains.
FLAGS = [
    "HighBP", "HighChol", "CholCheck", "Stroke", "HeartDiseaseorAttack", "Smoker",
    "PhysActivity", "Fruits", "Veggies", "Sex",
]
CONSTRAINTS = (
    [Constraint(c, codes=(0, 1)) for c in FLAGS]
    + [
        Constraint("Age", codes=tuple(range(1, 14))),
        Constraint("GenHlth", codes=tuple(range(1, 6))),
        Constraint("Education", codes=tuple(range(1, 7))),
        Constraint("Income", codes=tuple(range(1, 9))),
        Constraint("BMI", low=10, high=50),
        Constraint("MentHlth", low=0, high=30),
        Constraint("PhysHlth", low=0, high=30),
    ]
)

# Display names of the columns.
FEATURE_NAMES = [
    ("HighBP", "Huyết Áp Cao"),
    ("HighChol", "Cholesterol Cao"),
    ("BMI", "BMI"),
    ("Smoker", "Hút Thuốc"),
    ("PhysActivity", "Hoạt Động Thể Chất"),
    ("Fruits", "Ăn Trái Cây"),
    ("GenHlth", "Sức Khỏe Tổng Quát"),
    ("MentHlth", "Sức Khỏe Tinh Thần"),
    ("PhysHlth", "Sức Khỏe Thể Chất"),
    ("Age", "Tuổi"),
    ("Education", "Học Vấn"),
    ("Income", "Thu Nhập"),
    ("Sex", "Giới Tính"),
]

# Display texts of the codes (feature, code, text) in the report.
VALUE_TEXTS = [
    ("HighBP", 0, "Không"), ("HighBP", 1, "Có"),
    ("HighChol", 0, "Không"), ("HighChol", 1, "Có"),
    ("Smoker", 0, "Không"), ("Smoker", 1, "Có"),
    ("PhysActivity", 0, "Không"), ("PhysActivity", 1, "Có"),
    ("Fruits", 0, "Không/Ít"), ("Fruits", 1, "Có"),
    ("Sex", 0, "Nữ"), ("Sex", 1, "Nam"),
    ("GenHlth", 1, "Rất tốt"), ("GenHlth", 2, "Tốt"), ("GenHlth", 3, "Khá tốt"),
    ("GenHlth", 4, "Trung bình"), ("GenHlth", 5, "Kém"),
]

# The form's texts for the banded codes.
FORM_TEXTS = [
    ("Age", 1, "18-24 tuổi"), ("Age", 2, "25-29 tuổi"), ("Age", 3, "30-34 tuổi"),
    ("Age", 4, "35-39 tuổi"), ("Age", 5, "40-44 tuổi"), ("Age", 6, "45-49 tuổi"),
    ("Age", 7, "50-54 tuổi"), ("Age", 8, "55-59 tuổi"), ("Age", 9, "60-64 tuổi"),
    ("Age", 10, "65-69 tuổi"), ("Age", 11, "70-74 tuổi"), ("Age", 12, "75-79 tuổi"),
    ("Age", 13, "80+ tuổi"),
    ("Education", 1, "Chưa học cấp 1"), ("Education", 2, "Học cấp 1"), ("Education", 3, "Học cấp 2"),
    ("Education", 4, "Học cấp 3"), ("Education", 5, "Học đại học 1 năm"), ("Education", 6, "Tốt nghiệp đại học"),
    ("Income", 1, "Dưới $10,000"), ("Income", 2, "$10,000-$15,000"), ("Income", 3, "$15,000-$20,000"),
    ("Income", 4, "$20,000-$25,000"), ("Income", 5, "$25,000-$35,000"), ("Income", 6, "$35,000-$50,000"),
    ("Income", 7, "$50,000-$75,000"), ("Income", 8, "Trên $75,000"),
]
