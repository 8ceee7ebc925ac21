"""The survey's gazetteers of names and places, in the order and the groups that they come in."""

# First names.
FIRST_NAMES = (
    # Male names
    "aakash", "aaditya", "aamir", "aamod", "aanan", "anan", "aankush", "aansh", "aarambh", "aarav", "aarush", "aaryan", "aryan", "aashish", "ashish",
    "aashutosh", "abhishek", "aditya", "agam", "agarwal", "ahana", "ahmad", "ahmed", "ajay", "akhil", "akshay", "aman", "amar", "amit", "amitabh", "amrendra",
    "anand", "ankit", "anmol", "anurag", "anush", "arjun", "arman", "armaan", "arun", "arvind", "ashok", "ashutosh", "atul", "avinash", "ayush", "ayushman",
    "babu", "badal", "bahadur", "balaji", "balbir", "bala", "banwari", "bhagat", "bhagwan", "bhai", "bhanu", "bharat", "bharti", "bhavesh", "bheem", "bhola",
    "bhopal", "bhuwan", "bipin", "bishal", "brajesh", "budh", "chandan", "chandra", "charan", "chetan", "chitrang", "daksh", "damodar", "daniel", "darshan",
    "dashrath", "deepak", "deeptesh", "dev", "devansh", "devendra", "dhananjay", "dhiraj", "dhruv", "dilip", "dinesh", "divyansh", "durga", "dwarka",
    "gajendra", "ganesh", "gaurav", "gautam", "girdhar", "girish", "gopal", "gopi", "govind", "guddu", "gulab", "guru", "hans", "hari", "harish", "harsh",
    "harshad", "harshvardhan", "hemant", "hitesh", "hrithik", "ikbal", "indra", "ishan", "jack", "jagat", "jagdish", "jai", "jaidev", "jatin", "jay", "jayant",
    "jignesh", "jitendra", "john", "jugal", "kailash", "karan", "karthik", "kartik", "kashi", "keshav", "kiran", "kishan", "kishore", "krishna", "krish",
    "kuber", "kumar", "kunal", "lakhan", "lakshman", "lal", "lalit", "lokesh", "madhav", "madhur", "mahesh", "manas", "manish", "manoj", "mohan", "mohit",
    "mukesh", "mukul", "murali", "nabin", "nadeem", "nagesh", "nakul", "nandan", "naresh", "narendra", "narayan", "naveen", "navin", "nayana", "neeraj",
    "nikhil", "nilesh", "nimai", "niranjan", "nirmal", "nitesh", "om", "omkar", "onkar", "pappu", "param", "parmesh", "parth", "pavan", "piyush", "prabal",
    "pradeep", "prakash", "pramod", "pranab", "pranav", "prasad", "prashant", "pratap", "prateek", "pravin", "prem", "priyansh", "puneet", "punit",
    "purushottam", "raghav", "raghu", "rahul", "rajan", "rajat", "rajeev", "rajendra", "rajesh", "rajiv", "raju", "rakesh", "ramesh", "ram", "ranjit", "rashmi",
    "ratan", "rathin", "raunak", "ravi", "ravindra", "rayan", "rehman", "rishi", "rishabh", "rohan", "rohit", "romi", "ronak", "ruchi", "rudra", "rupal",
    "rupesh", "sachin", "sadiq", "sagar", "sahil", "saikat", "sai", "sajal", "saket", "salim", "sam", "samir", "sameer", "sanchit", "sandip", "sandeep",
    "sanjay", "sanjiv", "sanket", "santanu", "santosh", "sarab", "saran", "sarthak", "satish", "satyam", "satya", "saurabh", "savan", "sayan", "seema",
    "shakti", "sham", "shambhu", "shankar", "shantanu", "shashi", "shikhar", "shishir", "shiva", "shreyas", "shrikant", "shriram", "shubham", "shyam",
    "siddharth", "siddhant", "siddhartha", "sikha", "som", "sonu", "soumen", "sourav", "sourabh", "srinivas", "subham", "subhash", "subodh", "subrata",
    "sudhir", "sudhanshu", "sujan", "sukanta", "sukesh", "suman", "sumit", "sundeep", "sunil", "sunny", "suraj", "suresh", "surya", "sushant", "sushil",
    "swapan", "swapnil", "swarup", "tapan", "tarun", "tejas", "tonmoy", "udit", "ujjwal", "umang", "upendra", "uttam", "vaibhav", "vicky", "vikas", "vikram",
    "vimal", "vinay", "virendra", "vishal", "vishnu", "vivek", "yash", "yogesh", "yogendra", "yuvraj",
    # Female names
    "aadhya", "aalia", "aarti", "aashna", "aastha", "aditi", "advika", "aganya", "aina", "aira", "aisha", "aishwarya", "akshara", "akshita", "alisha", "amaira",
    "amara", "ambika", "amisha", "amrita", "anamika", "ananya", "anika", "anisha", "anita", "anjali", "ankita", "annapurna", "anshika", "antara", "anvi", "anu",
    "anuradha", "aparna", "archana", "arushi", "arya", "ashwini", "avni", "babita", "bani", "barkha", "bhavana", "bhavya", "bimla", "bindiya", "chanda",
    "chandni", "chhavi", "damini", "danya", "deepa", "deepali", "deeksha", "deena", "devika", "dhanashree", "dhara", "disha", "divya", "dyuti", "ela", "elina",
    "ganga", "gargi", "gauri", "gayatri", "geeta", "geetanjali", "gita", "hansa", "hema", "hemali", "heena", "honey", "indira", "indu", "ishita", "jagruti",
    "jahnvi", "jalaja", "janaki", "jaya", "jayashree", "jhanvi", "jyoti", "kajal", "kalyani", "kamakshi", "kamini", "kanchan", "kanika", "kanti", "karishma",
    "kashish", "kavita", "khushi", "kirti", "komal", "kumkum", "kumari", "laila", "lakshmi", "lalita", "latha", "leela", "leena", "madhuri", "madhu", "mahi",
    "mahima", "mamta", "manasi", "manisha", "manju", "manya", "maya", "meena", "meenakshi", "megha", "mehak", "menka", "mira", "mohini", "mona", "mridula",
    "mukta", "mumbai", "muna", "naina", "nandini", "nanaki", "neelam", "neena", "neha", "niharika", "nikita", "nisha", "nishi", "nita", "nitika", "nitya",
    "palak", "pallavi", "pampa", "panchi", "pankaj", "pari", "paridhi", "parul", "parvati", "payal", "poonam", "poornima", "prachi", "pragati", "pratima",
    "pratibha", "prema", "premlata", "priya", "priyanka", "priyanshi", "purnima", "puru", "purvi", "radha", "radhika", "ragini", "raji", "rajni", "rati",
    "ratna", "reema", "rekha", "ria", "richa", "rinki", "rithika", "rohini", "roma", "roshni", "rupali", "rupa", "sabnam", "sachi", "sadhana", "sadhvi",
    "sagarika", "sahana", "sailee", "sakshi", "sana", "sangita", "saniya", "sanjana", "santana", "sanya", "sara", "sarla", "sarita", "shailja", "shakshi",
    "shampa", "shanti", "sharada", "sharmila", "sheetal", "shikha", "shilpa", "shobha", "shreya", "shriya", "shruti", "shubha", "siddhi", "simran", "sita",
    "smriti", "sneha", "sonakshi", "sonam", "sonia", "subha", "suchitra", "sudha", "sujata", "sukanya", "sumati", "sumitra", "sunita", "sunaina", "supriya",
    "surabhi", "surbhi", "sushma", "swara", "swati", "sweta", "tanvi", "tanushree", "tara", "trishna", "udita", "uma", "urvi", "usha", "vaishali", "vanaja",
    "vanisha", "varsha", "vastav", "veena", "vidya", "vijaya", "vimala", "vimla", "vinod", "viraj", "vishakha", "yaana", "yamini", "yashoda", "yogita", "zara",
    "zarina",
)

# Surnames.
SURNAMES = (
    "agrawal", "agrawala", "aggarwal", "ahire", "ahluwalia", "aich", "arya", "babu", "baidya", "bajaj", "bajpai", "bakshi", "bala", "balakrishnan", "balan",
    "banerjee", "banik", "bansal", "banoth", "baral", "barkataki", "barman", "barthakur", "barua", "baruah", "batabyal", "bathula", "battini", "bedi",
    "bhadani", "bhadoria", "bhagat", "bhagwat", "bhai", "bhakta", "bhandari", "bhangare", "bharadwaj", "bharati", "bhat", "bhatia", "bhatnagar", "bhatt",
    "bhattacharjee", "bhattacharya", "bhaumik", "bhavsar", "bhel", "bhoi", "bhopale", "bhowmick", "bhuban", "bora", "borah", "bordoloi", "bose", "brahma",
    "brahmbhatt", "chaudhary", "chaudhri", "chaudhuri", "chauhan", "chawla", "cherukuri", "chopra", "choudhary", "choudhury", "chowdhury", "das", "dass",
    "datta", "david", "de", "deka", "dey", "dhaliwal", "dhanraj", "dhawan", "dhillon", "dikshit", "dixit", "dobhal", "dodiya", "dongre", "dube", "dubey",
    "dugar", "dutta", "dwivedi", "gaba", "gadhavi", "gandhi", "ganguly", "garg", "garodia", "gaur", "gautam", "gawli", "ghai", "ghose", "ghosh", "gill",
    "gogoi", "gokhale", "gopal", "gopalan", "goswami", "goud", "goyal", "grewal", "grover", "guha", "gupta", "halder", "handa", "hans", "hari", "hazarika",
    "hela", "hora", "iyengar", "iyer", "jadhav", "jaggi", "jain", "jaiswal", "jakhar", "jani", "janorkar", "jarngal", "javali", "jayaraman", "jha", "jhaveri",
    "johar", "joshi", "junjappa", "kabra", "kadam", "kadian", "kadyan", "kakkar", "kalra", "kamal", "kamble", "kanda", "kant", "kapoor", "kar", "karam",
    "karnik", "karthik", "karunakaran", "kashyap", "kaul", "kaur", "kawatra", "kedia", "keer", "khadka", "khalid", "khan", "khanna", "kharwar", "khatri",
    "khatun", "khurana", "kochhar", "koli", "konda", "konwar", "koren", "kothari", "krishna", "krishnamurthy", "krishnan", "kulkarni", "kumar", "kumari",
    "kundu", "kurian", "kurmi", "kurup", "kushwaha", "kwatra", "lad", "lal", "lakshmi", "lakshman", "lanka", "laskar", "latha", "lau", "luther", "madan",
    "madhav", "madhavan", "mahajan", "mahal", "mahanta", "mahato", "maheshwari", "mahi", "majhi", "majumdar", "malhotra", "malik", "mallick", "malla", "mammen",
    "mandal", "mane", "mangal", "mangat", "manjhi", "manjrekar", "manral", "marar", "masih", "mathur", "maurya", "meena", "mehta", "mehto", "menon", "mer",
    "mishra", "mistry", "mittal", "mohan", "mohanty", "mukherjee", "mukhopadhyay", "munda", "murthy", "murmu", "musaddi", "nagi", "nagpal", "nagpure", "naidu",
    "naik", "nair", "nakra", "nanavati", "nanda", "nandrajog", "narang", "narendran", "narula", "nashine", "nath", "nawal", "nehra", "nigam", "oberoi", "pal",
    "palekar", "palli", "pande", "pandey", "pandit", "pandya", "pant", "parashar", "parida", "parmar", "parsana", "parthiban", "parveen", "paswan", "patel",
    "pathak", "patil", "patnaik", "patri", "pattanayak", "paul", "pawar", "phadke", "phogat", "pillai", "poddar", "prabhakar", "prabhu", "pradhan", "prasad",
    "pratap", "prem", "puri", "pujari", "pulkit", "purohit", "radhakrishnan", "raghavan", "raghuvanshi", "raikwar", "raipuria", "raju", "ramesh", "ranganathan",
    "rao", "rastogi", "rath", "rathod", "rathore", "raut", "ravi", "rawal", "rawat", "ray", "razdan", "reddy", "revri", "rewar", "reyansh", "riya", "rohith",
    "roy", "rughani", "saha", "sahani", "sahay", "saikia", "saini", "salvi", "sampath", "samuel", "sandilya", "sane", "sanghvi", "sangma", "sangwan", "sania",
    "sankar", "santosh", "sanyal", "sapra", "sarangi", "sarma", "sarraf", "saraf", "sashi", "sasidharan", "sathe", "saxena", "seal", "sehgal", "sem", "sen",
    "seth", "sethi", "shah", "shandilya", "shanmugam", "sharma", "sharraf", "shashi", "shastri", "shelke", "shende", "sherwal", "shetty", "shiv", "shome",
    "shrikant", "shroff", "shukla", "siddiqui", "sidhu", "singh", "sinha", "sodhi", "solanki", "som", "soman", "somani", "sonar", "soni", "sonkar", "sontake",
    "sood", "sridhar", "srinivasan", "srivastava", "subramanian", "subramaniam", "sud", "sudhir", "sugathan", "sule", "sultana", "sunder", "sundaram",
    "sundararajan", "surana", "sureka", "suresh", "suri", "surve", "swaminathan", "swamy", "tandon", "taneja", "tank", "tanwar", "tapan", "tarafdar", "tewari",
    "thakkar", "thakur", "thanvi", "thapa", "thapar", "tharakan", "tharoor", "thigala", "thombre", "thorat", "tiwari", "tomar", "tripathi", "tyagi", "ujjwal",
    "umar", "upadhyay", "uppal", "vaidya", "vaish", "vaishnav", "vajpayee", "vani", "varma", "varshney", "varughese", "venkatesh", "venkataraman", "verma",
    "vidya", "vig", "vij", "vijay", "vijayan", "vijayaraghavan", "vikram", "vikramaditya", "vinod", "virat", "viswanathan", "vohra", "vyas", "wadhwa", "wagle",
    "walia", "wali", "warrier", "wattal", "yadav", "yogi", "zakaria", "zehra", "zinta",
)

# Name stop words.
NAME_STOP_WORDS = (
    # Query words
    "find", "search", "look", "show", "get", "list", "all", "any", "who", "what", "where", "when", "how", "having", "with", "from", "connected", "linked",
    "related", "relation", "phone", "mobile", "email", "address", "location", "city", "state", "country", "company", "bank", "account",
    # Common verbs/adjectives
    "and", "or", "the", "a", "an", "this", "that", "these", "those", "is", "are", "was", "were", "been", "being", "have", "has", "had", "do", "does", "did",
    "will", "would", "could", "should", "may", "might", "must", "shall", "can", "need", "dare", "ought", "used", "to", "of", "in", "for", "on", "by", "about",
    "like", "through", "over", "before", "after", "between", "under", "again", "further", "then", "once",
    # Entity type words
    "person", "people", "man", "woman", "boy", "girl", "individual", "suspect", "victim", "witness", "transaction", "record", "data", "information", "details",
    "number", "type", "status", "date", "amount", "balance", "credit", "debit", "transfer", "payment",
    # Relationship indicators
    "relationship", "relationships", "types", "connections", "connection", "associated",
)

# Cities.
CITIES = (
    # Metro cities
    "mumbai", "delhi", "bangalore", "bengaluru", "chennai", "kolkata", "hyderabad", "pune", "ahmedabad",
    # State capitals
    "bhopal", "bhubaneswar", "chandigarh", "dehradun", "dispur", "gangtok", "imphal", "itanagar", "jaipur", "jammu", "kohima", "lucknow", "panaji", "patna",
    "raipur", "ranchi", "shillong", "shimla", "srinagar", "thiruvananthapuram", "trivandrum",
    # Major cities
    "agra", "ajmer", "aligarh", "allahabad", "prayagraj", "amritsar", "aurangabad", "bareilly", "belgaum", "bhavnagar", "bhiwandi", "bikaner", "bilaspur",
    "coimbatore", "cuttack", "davanagere", "dhanbad", "durgapur", "erode", "farrukhabad", "firozabad", "gaya", "ghaziabad", "gorakhpur", "gulbarga", "guntur",
    "gurgaon", "guwahati", "gwalior", "howrah", "hubli", "indore", "jabalpur", "jalandhar", "jamnagar", "jamshedpur", "jhansi", "jodhpur", "kakinada", "kannur",
    "kanpur", "kochi", "kollam", "kota", "kottayam", "kozhikode", "ludhiana", "madurai", "malegaon", "mangalore", "meerut", "mirzapur", "moradabad",
    "muzaffarnagar", "muzaffarpur", "mysore", "nagpur", "nanded", "nashik", "nellore", "noida", "palakkad", "patiala", "rajahmundry", "rajkot", "rourkela",
    "saharanpur", "salem", "sangli", "satara", "siliguri", "solapur", "surat", "thanjavur", "thiruppur", "thrissur", "tiruchirappalli", "tirunelveli",
    "tirupati", "udaipur", "udupi", "ujjain", "vadodara", "varanasi", "vijayawada", "visakhapatnam", "vizag", "warangal",
    # Union Territories
    "port blair", "daman", "diu", "kavaratti", "puducherry", "pondicherry",
    # Districts and smaller cities
    "alwar", "bardhaman", "bharatpur", "bhilwara", "bijapur", "bulandshahr", "darbhanga", "dharwad", "english bazar", "etawah", "fatehpur", "gandhidham",
    "gandhinagar", "haldia", "hazaribag", "jehanabad", "junagadh", "khandwa", "kharagpur", "maheshtala", "mathura", "maunath bhanjan", "mango", "navi mumbai",
    "nizamabad", "proddatur", "rohtak", "sambalpur", "silchar", "sirsa", "sonipat", "south dumdum", "sultan pur majra", "tinsukia", "tumkur", "west dumdum",
)

# States.
STATES = (
    "andhra pradesh", "arunachal pradesh", "assam", "bihar", "chhattisgarh", "goa", "gujarat", "haryana", "himachal pradesh", "jharkhand", "karnataka",
    "kerala", "madhya pradesh", "maharashtra", "manipur", "meghalaya", "mizoram", "nagaland", "odisha", "orissa", "punjab", "rajasthan", "sikkim", "tamil nadu",
    "telangana", "tripura", "uttar pradesh", "uttarakhand", "uttaranchal", "west bengal",
    # Union Territories
    "andaman and nicobar", "chandigarh", "dadra and nagar haveli", "daman and diu", "delhi", "jammu and kashmir", "ladakh", "lakshadweep", "puducherry",
    "pondicherry",
)
