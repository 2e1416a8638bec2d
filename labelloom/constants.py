"""Values that results depend on: codes, names, formats and limits."""

# Label words, codes and display names.
LABEL_WORDS = {"negative": 0, "neutral": 1, "positive": 2}
DEFAULT_LABEL = 1
SERVING_NAMES = {0: "Tiêu cực", 1: "Trung tính", 2: "Tích cực"}
OFFLINE_NAMES = {0: "Tiêu cực", 1: "Trung lập", 2: "Tích cực"}
PROMPT_NAMES = {0: "tiêu cực", 1: "trung lập", 2: "tích cực"}
PROMPT_DEFAULT = "trung lập"
MISSING_TEXT_MESSAGE = "Thiếu dữ liệu"

# The request sent for one sentence, filled with label name and sentence.
PARAPHRASE_REQUEST = (
    "Dưới đây là một câu biểu thị cảm xúc %s. "
    "Hãy viết lại câu này theo cách khác nhưng giữ nguyên nghĩa và cảm xúc đó.\n"
    'Câu gốc: "%s"\n'
    "Câu viết lại:"
)

# Categories to be filled and the label each one carries.
CATEGORIES = {
    "Bất mãn sâu sắc (về chương trình học, nội quy trường, cơ sở vật chất)": 0,
    "Tức giận dữ dội (biểu đạt sự khó chịu tột độ với giảng viên, bạn học)": 0,
    "Buồn bã cùng cực (nỗi thất vọng, mất mát trong học tập)": 0,
    "Sợ hãi/lo lắng cực độ (về tương lai, kết quả học tập)": 0,
    "Chỉ trích nặng nề (đối với cách dạy, phương pháp đánh giá)": 0,
    "Thất vọng sâu sắc (về kỳ vọng không được đáp ứng)": 0,
    "Cô đơn tột cùng (cảm giác bị cô lập, thiếu kết nối)": 0,
    "Oán giận cay nghiệt (về cơ sở vật chất và môi trường học tập tồi tàn)": 0,
    "Phẫn nộ không kiềm chế (về chính sách học phí và tài chính của nhà trường)": 0,
    "Biết ơn sâu sắc (với giáo viên về sự tận tâm và kiến thức truyền đạt)": 2,
    "Hạnh phúc tràn đầy (với trải nghiệm học tập bổ ích và thú vị)": 2,
    "Ngưỡng mộ chân thành (với chuyên môn và phương pháp giảng dạy của giáo viên)": 2,
    "Hứng khởi mạnh mẽ (với nội dung bài học và cách truyền đạt sáng tạo)": 2,
    "Phấn chấn tích cực (với môi trường học tập và bạn học đầy hỗ trợ)": 2,
    "Tự tin vững vàng (với kiến thức và kỹ năng đã học được sau khóa học)": 2,
    "Tự hào to lớn (về thành tích học tập và sự tiến bộ của bản thân)": 2,
    "Yêu thích sâu đậm (đối với môn học và chuyên ngành đang theo học)": 2,
    "Trân trọng sâu sắc (đối với cơ sở vật chất hiện đại và đầy đủ của nhà trường)": 2,
    "Hài lòng tuyệt đối (với chính sách học phí và hỗ trợ tài chính của nhà trường)": 2,
}

# Limits and sizes.
MIN_CHARS, MAX_CHARS = 50, 100
TARGET_PER_CATEGORY = 2000
TRAIN_FRACTION, VAL_FRACTION, HOLDOUT_FRACTION = 0.8, 0.1, 0.1
FIRST_ID = 10000
BATCH_SIZE = 16
MAX_LEN, SERVING_MAX_LEN = 256, 128
START_ID, PAD_ID, END_ID, UNKNOWN_ID, FIRST_TOKEN_ID = 0, 1, 2, 3, 4
NUM_CLASSES = 3
MAX_PASSES = 12
WEIGHT_DECAY = 0.01

# Rows of the comparison table.
DATASET_NAMES = {"train": "Train", "val": "Validation", "test": "Test"}
BASELINE_NAME, BASELINE_ACCURACY, BASELINE_F1 = "Baseline", 0.879, 0.879
