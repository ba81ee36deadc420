"""The bilingual concept table: a key, what it looks like, what is said about it."""

# Key, visual terms, audio terms, in the order in which keys of one
# length are matched.
CONCEPTS: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("สีเขียว", ("green", "emerald", "green shirt", "green clothing"), ("เขียว", "green")),
    ("เขียว", ("green", "emerald", "green shirt", "green clothing"), ("เขียว", "green")),
    ("สีแดง", ("red", "crimson", "red shirt", "red clothing"), ("แดง", "red")),
    ("แดง", ("red", "crimson", "red shirt", "red clothing"), ("แดง", "red")),
    ("สีน้ำตาล", ("brown", "tan", "brown shirt", "brown polo", "khaki"), ("น้ำตาล", "brown")),
    ("น้ำตาล", ("brown", "tan", "brown shirt", "brown polo", "khaki"), ("น้ำตาล", "brown")),
    ("สีดำ", ("black", "dark", "black shirt", "black clothing"), ("ดำ", "black")),
    ("ดำ", ("black", "dark", "black shirt", "black clothing"), ("ดำ", "black")),
    ("สีขาว", ("white", "light", "white shirt", "white clothing"), ("ขาว", "white")),
    ("ขาว", ("white", "light", "white shirt", "white clothing"), ("ขาว", "white")),
    ("สีน้ำเงิน", ("blue", "navy", "dark blue", "blue shirt"), ("น้ำเงิน", "blue")),
    ("น้ำเงิน", ("blue", "navy", "dark blue", "blue shirt"), ("น้ำเงิน", "blue")),
    ("สีฟ้า", ("blue", "cyan", "sky blue", "blue shirt"), ("ฟ้า", "blue")),
    ("ฟ้า", ("blue", "cyan", "sky blue", "blue shirt"), ("ฟ้า", "blue")),
    ("สีเหลือง", ("yellow", "gold", "yellow shirt"), ("เหลือง", "yellow")),
    ("เหลือง", ("yellow", "gold", "yellow shirt"), ("เหลือง", "yellow")),
    ("สีส้ม", ("orange", "orange shirt"), ("ส้ม", "orange")),
    ("ส้ม", ("orange", "orange shirt"), ("ส้ม", "orange")),
    ("สีชมพู", ("pink", "rose", "pink shirt"), ("ชมพู", "pink")),
    ("ชมพู", ("pink", "rose", "pink shirt"), ("ชมพู", "pink")),
    ("สีม่วง", ("purple", "violet", "purple shirt"), ("ม่วง", "purple")),
    ("ม่วง", ("purple", "violet", "purple shirt"), ("ม่วง", "purple")),
    ("สีเทา", ("gray", "grey", "gray shirt"), ("เทา", "gray")),
    ("เทา", ("gray", "grey", "gray shirt"), ("เทา", "gray")),
    ("เสื้อ", ("shirt", "t-shirt", "polo", "clothing", "apparel", "top", "jacket"), ("เสื้อ", "shirt")),
    ("กางเกง", ("pants", "trousers", "jeans", "shorts"), ("กางเกง", "pants")),
    ("แว่น", ("glasses", "eyeglasses", "spectacles"), ("แว่น", "glasses")),
    ("แว่นตา", ("glasses", "eyeglasses", "spectacles"), ("แว่น", "แว่นตา", "glasses")),
    ("หมวก", ("hat", "cap", "helmet"), ("หมวก", "hat")),
    ("รองเท้า", ("shoes", "sneakers", "boots"), ("รองเท้า", "shoes")),
    ("คน", ("person", "people", "man", "individual", "someone"), ("คน", "person")),
    ("ผู้ชาย", ("man", "guy", "male", "gentleman", "boy"), ("ผู้ชาย", "man")),
    ("ชาย", ("man", "guy", "male", "boy"), ("ชาย", "man")),
    ("หนุ่ม", ("young man", "guy", "man"), ("หนุ่ม", "man")),
    ("ผู้หญิง", ("woman", "female", "lady", "girl"), ("ผู้หญิง", "woman")),
    ("หญิง", ("woman", "female", "lady", "girl"), ("หญิง", "woman")),
    ("สาว", ("young woman", "girl", "woman"), ("สาว", "woman")),
    ("เด็ก", ("child", "kid", "baby"), ("เด็ก", "kid")),
    ("อาจารย์", ("teacher", "professor", "lecturer", "instructor", "presenter", "speaker"), ("อาจารย์", "ครู", "professor")),
    ("ครู", ("teacher", "instructor", "lecturer"), ("ครู", "อาจารย์", "teacher")),
    ("ผู้บรรยาย", ("speaker", "presenter", "lecturer"), ("ผู้บรรยาย", "speaker")),
    ("นักเรียน", ("student", "pupil"), ("นักเรียน", "student")),
    ("นักศึกษา", ("student", "university student"), ("นักศึกษา", "student")),
    ("ใส่", ("wearing", "dressed in", "wears"), ("ใส่", "wear")),
    ("สวม", ("wearing", "dressed in", "putting on"), ("สวม", "wear")),
    ("นั่ง", ("sitting", "seated", "sits", "chair", "desk"), ("นั่ง", "sit")),
    ("ยืน", ("standing", "stands", "upright"), ("ยืน", "stand")),
    ("ยิ้ม", ("smiling", "smiles", "grin", "happy"), ("ยิ้ม", "smile")),
    ("หัวเราะ", ("laughing", "laughs", "chuckle"), ("หัวเราะ", "laugh")),
    ("ยกมือ", ("raising hand", "hand raised", "reaches hand", "gesturing"), ("ยกมือ", "ถาม", "hand")),
    ("หัน", ("turning", "looking", "glancing"), ("หัน", "มอง", "look")),
    ("ดื่ม", ("drinking", "cup", "bottle", "sip", "water", "glass"), ("กลืน", "ดื่ม", "น้ำ", "drink", "water")),
    ("กิน", ("eating", "food", "plate", "spoon", "fork", "meal"), ("กิน", "อร่อย", "ทาน", "eat", "food")),
    ("ทาน", ("eating", "food", "plate", "meal"), ("ทาน", "กิน", "eat")),
    ("พูด", ("speaking", "talking", "microphone", "speaker", "presenter"), ("สวัสดี", "พูด", "กล่าว", "explain", "discuss", "presentation")),
    ("บรรยาย", ("presenting", "speaker", "presentation", "lecture"), ("บรรยาย", "อธิบาย", "lecture", "present")),
    ("อธิบาย", ("explaining", "pointing", "presentation"), ("อธิบาย", "กล่าว", "explain")),
    ("สไลด์", ("slide", "presentation", "screen", "chart", "diagram", "table", "monitor"), ("สไลด์", "กราฟ", "ภาพนี้", "ตามตาราง", "slide", "chart", "figure")),
    ("กราฟ", ("chart", "bar chart", "line plot", "figure", "diagram"), ("กราฟ", "ร้อยละ", "เปอร์เซ็นต์", "แกน", "axis", "percentage", "trend")),
    ("รถ", ("car", "vehicle", "automobile", "road", "street", "traffic"), ("เสียงรถ", "เครื่องยนต์", "car", "engine", "drive")),
    ("รถยนต์", ("car", "vehicle", "automobile", "road"), ("รถ", "รถยนต์", "car")),
    ("มอเตอร์ไซค์", ("motorcycle", "motorbike", "scooter", "bike"), ("มอเตอร์ไซค์", "จักรยานยนต์", "motorcycle")),
    ("จักรยานยนต์", ("motorcycle", "motorbike", "scooter", "bike"), ("จักรยานยนต์", "มอเตอร์ไซค์", "motorcycle")),
    ("เลี้ยว", ("turning", "turns", "swerve", "corner"), ("เลี้ยว", "turn")),
    ("ตัดหน้า", ("cut in front", "cutting off", "sudden turn"), ("ตัดหน้า", "cut in front")),
    ("เดิน", ("walking", "walk", "feet", "pedestrian", "path"), ("เดิน", "ก้าว", "walk", "step")),
    ("วิ่ง", ("running", "jogging", "sprint"), ("วิ่ง", "run")),
    ("เขียน", ("writing", "pen", "paper", "whiteboard", "typing"), ("เขียน", "จด", "write", "note", "type")),
    ("จด", ("writing", "taking notes", "pen", "paper"), ("จด", "เขียน", "note")),
    ("คอมพิวเตอร์", ("computer", "laptop", "monitor", "screen", "pc", "desktop"), ("คอม", "คอมพิวเตอร์", "computer")),
    ("คอม", ("computer", "laptop", "monitor", "screen"), ("คอม", "computer")),
)
